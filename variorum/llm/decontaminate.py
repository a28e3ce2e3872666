"""Benchmark decontamination: size-partitioned MinHash containment search, native."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\p{L}\p{N}]+"
#: A table of item sketches this small is broadcast; a larger one is joined by its hashes.
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), lambda w: w != "")


def _shingles(k: str) -> str:
    return f"transform(sequence(1, size(words) - {k} + 1), i -> array_join(slice(words, i, {k}), ' '))"


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle_words: int = 5, containment: tuple[int, int] = (4, 5), miss: float = 1e-9) -> DataFrame:
    """(id_col, item_id_col, n_item_shingles, n_shared, containment), a row per document and item in it.

    Words are runs of letters and digits, in lower case. An item is in a document
    which has num/den or more of the item's distinct shingles. Items are
    partitioned by their number of shingles. Up to the number of hash functions
    that a containment of num/den misses with a chance below `miss`, the sketch is
    all shingles; above, it is the shingle of least hash for each function. By
    MinHash the share of an item's sketch that a document holds is the item's
    containment in it, however long the document is; a document with one sketched
    shingle is a candidate, and its full shingles decide.

    Items with fewer words than a shingle have their whole sequence as one, looked
    up among the documents' sequences of that many words. Null and empty texts have
    no words; such items are in nothing. Rows with a null id aren't reported. Rows
    that repeat a document's id count as one with all their shingles at best; of
    rows repeating an item's id each item counts by itself, the highest is kept.
    """
    num, den = containment
    functions = math.ceil(math.log(miss) / math.log(1 - num / den))
    own = items.select(F.col(item_id_col).alias("item"), _words(F.col(item_text_col)).alias("words")).filter("item is not null and size(words) > 0")
    own = own.withColumn("k", F.least(F.size("words"), F.lit(shingle_words)))
    own = own.select("item", "k", F.array_distinct(F.expr(_shingles("k"))).alias("shingles")).withColumn("n", F.size("shingles"))
    small = own.filter(F.col("n") <= functions).select("item", "k", F.explode("shingles").alias("shingle"))
    draws = F.expr(f"transform(sequence(1, {functions}), f -> array_min(transform(shingles, s -> struct(xxhash64(f, s) as h, s as s))).s)")
    large = own.filter(F.col("n") > functions).select("item", "k", F.explode(F.array_distinct(draws)).alias("shingle"))
    sketch = small.unionByName(large).select("item", "k", F.xxhash64("shingle").alias("h")).distinct()
    lengths = [r.k for r in own.select("k").distinct().orderBy("k").collect()]  # 1 to shingle_words
    if sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)

    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    worded = texts.select("doc", _words(F.col("text")).alias("words"))
    hashed = [worded.filter(F.size("words") >= k).select("doc", F.lit(k).alias("k"), F.explode(F.expr(f"transform(sequence(1, size(words) - {k - 1}), i -> xxhash64(array_join(slice(words, i, {k}), ' ')))")).alias("h")) for k in lengths]
    if not hashed:
        hashed = [worded.filter("false").select("doc", F.lit(0).alias("k"), F.lit(0).cast("long").alias("h"))]
    probes = hashed[0]
    for more in hashed[1:]:
        probes = probes.unionByName(more)
    candidates = probes.join(sketch, ["h", "k"]).select("doc", "item").distinct()

    full = candidates.join(texts, "doc").select("doc", "item", _words(F.col("text")).alias("words")).join(own, "item")
    held = F.size(F.array_intersect("shingles", F.expr(_shingles("k"))))
    exact = full.filter("size(words) >= k").select("doc", "item", "n", held.alias("held"))
    exact = exact.filter(f"held * {den} >= n * {num}").withColumn("share", F.col("held") / F.col("n"))
    best = exact.groupBy("doc", "item").agg(F.max(F.struct("share", "n", "held")).alias("best"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col), F.col("best.n").cast("long").alias("n_item_shingles"), F.col("best.held").cast("long").alias("n_shared"), F.col("best.share").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose document holds an item; rows with a null id stay."""
    found = contained_items(docs, items, id_col=id_col, **options).select(id_col).distinct()
    return docs.join(found, id_col, "left_anti").select(docs.columns)

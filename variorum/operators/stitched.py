"""The stitched diff: neighbouring pages as one text, their differences led back to their pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators import diff, pages

# fixed values: the least anchors of a segment, and the least characters of its two texts
ANCHORS, LEAST_CHARS = 2, 20
_HUNK = pa.list_(pa.struct([("seq", pa.int32()), ("tag", pa.string()), ("a_text", pa.string()), ("b_text", pa.string()), ("i1", pa.int32()), ("j1", pa.int32()), ("gap", pa.int32()), ("page", pa.int64()), ("places", pa.list_(pa.int64()))]))
HUNKS = "array<struct<seq:int,tag:string,a_text:string,b_text:string,i1:int,j1:int,gap:int,page:long,places:array<long>>>"


def over_page_ends(words: list[str], pages_of: list[int]) -> tuple[list[str], list[int]]:
    """The words with those joined that a hyphen parts at a page's end; such a word has the page of the word before it."""
    out: list[str] = []
    own: list[int] = []
    for n, (word, page) in enumerate(zip(words, pages_of, strict=True)):
        if out and n and pages_of[n - 1] != page and len(out[-1]) > 1 and out[-1][-1] == "-" and (out[-1][-2].isalnum() or out[-1][-2] == "_"):
            out[-1] = out[-1][:-1] + word
            own[-1] = own[-2] if len(own) > 1 else own[-1]
        else:
            out.append(word)
            own.append(page)
    return out, own


def gaps_between(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]] | None:
    """(i1, i2, j1, j2) of the stretches between the anchors; None for too few anchors."""
    found = [x for x in diff.anchors(a, b) if x[2] >= diff.ANCHOR]
    if len(found) < ANCHORS:
        return None
    out, i, j = [], 0, 0
    for at, bt, size in [*found, (len(a), len(b), 0)]:
        if at > i or bt > j:
            out.append((i, at, j, bt))
        i, j = at + size, bt + size
    return out


def stitched_hunks(a: list[str], b: list[str], pages_of: list[int]) -> list[dict] | None:
    """The differences of a segment; page is that of a difference, or of its gap's start.

    `places` has the pages of all places in the gap of the first word of b_text: a
    replacement belongs to the n-th of them, if it is the n-th one kept in its gap that
    begins with the word, which is known only once the others are sorted out.
    """
    gaps = gaps_between(a, b)
    if gaps is None:
        return None
    out: list[dict] = []
    for number, (i1, i2, j1, j2) in enumerate(gaps):
        start = pages_of[j1] if j1 < len(pages_of) else pages_of[0]
        for tag, x, y, i, j in diff.gap_hunks(a[i1:i2], b[j1:j2], i1, j1):
            page, places = start, []
            if tag == "extra":
                page = pages_of[j]
            elif tag != "missing" and y:
                word = y.split(" ", 1)[0]
                places = [pages_of[k] for k in range(j1, j2) if b[k] == word]
            out.append({"seq": len(out), "tag": tag, "a_text": x, "b_text": y, "i1": i, "j1": j, "gap": number, "page": page, "places": places})
    return out


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [c for c in batch.schema.names if c not in ("a_norm", "words", "pages_of")]
        rows = []
        for a, b, p in zip(*(batch.column(c).to_pylist() for c in ("a_norm", "words", "pages_of")), strict=True):
            rows.append(stitched_hunks([x for x in a.split(" ") if x], *over_page_ends(b, p)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, _HUNK)], names=[*keep, "hunks"])


def segments(books: DataFrame, alignments: DataFrame, own: DataFrame, book: str = "book_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """(book, segment_id, pg_start, a_norm, words, pages_of): the two texts of each segment; short ones are left out.

    books has (book, body_text), alignments (book, scan_page, pg_start, pg_end), own
    (book, page, text). A page counts once in a segment, however often it is aligned.
    """
    parts = pages.segments(alignments, book, "scan_page")
    spans = parts.groupBy(book, "segment_id").agg(F.min("pg_start").alias("pg_start"), F.max("pg_end").alias("pg_end"))
    norm = T.normalize_for_diff(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""))
    said = own.select(book, F.col(page).alias("scan_page"), norm.alias("norm")).filter("norm <> ''")
    met = parts.select(book, "segment_id", "scan_page").distinct().join(said, [book, "scan_page"])
    words = F.transform(T.tokens(F.col("norm")), lambda w: F.struct(w.alias("word"), F.col("scan_page").cast("long").alias("page")))
    listed = F.array_sort(F.collect_list(F.struct("scan_page", words.alias("words"), F.length("norm").alias("size"))))
    stitched = met.groupBy(book, "segment_id").agg(listed.alias("x"))
    flat = F.flatten(F.transform("x", lambda p: p["words"]))
    size = F.aggregate("x", F.lit(-1), lambda s, p: s + p["size"] + 1)
    both = stitched.withColumns({"all": flat, "size": size}).join(spans, [book, "segment_id"]).join(books.select(book, "body_text"), book)
    passage = F.substring("body_text", (F.col("pg_start") + 1).cast("int"), (F.col("pg_end") - F.col("pg_start")).cast("int"))
    ready = both.filter((F.col("size") >= LEAST_CHARS) & (F.length(passage) >= LEAST_CHARS) & (F.size("all") > 0))
    out = ready.select(book, "segment_id", "pg_start", T.normalize_for_diff(passage).alias("a_norm"), F.transform("all", lambda w: w["word"]).alias("words"), F.transform("all", lambda w: w["page"]).alias("pages_of"))
    return out.filter("a_norm <> ''")


def candidates(books: DataFrame, alignments: DataFrame, own: DataFrame, book: str = "book_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """(book, segment_id, pg_start, seq, tag, i1, j1, pg_text, scan_text, category, diff_description, scan_page, whole, pg_offset_ref).

    Where a segment has too few anchors, its pages are compared each by itself, flat;
    their rows aren't `whole` and have the alignment's place in the segment before the
    seq. pg_start is the start of the text in which i1 counts words, the segment's or the
    alignment's. A segment is one task's work. pg_offset_ref adds a word's number to
    that start (Q1).
    """
    ready = segments(books, alignments, own, book, page, text)
    kind = dict(ready.dtypes)[book]
    dealt = ready.repartition(book, "segment_id")
    told = dealt.mapInArrow(_differ, f"`{book}` {kind}, segment_id long, pg_start long, hunks {HUNKS}")
    found = told.select(book, "segment_id", "pg_start", F.explode("hunks").alias("h")).select(book, "segment_id", "pg_start", "h.*")
    first = F.when(F.size("places") > 0, F.split("scan_text", " ")[0])
    kept = diff.candidates(found).withColumn("word", first)
    nth = F.row_number().over(Window.partitionBy(book, "segment_id", "gap", "word").orderBy("seq"))
    placed = kept.withColumn("scan_page", F.when(F.col("word").isNotNull(), F.coalesce(F.get("places", nth - 1), F.col("page"))).otherwise(F.col("page")))
    columns = [book, "segment_id", "pg_start", "seq", "tag", "i1", "j1", "pg_text", "scan_text", "category", "diff_description", "scan_page"]
    placed = placed.select(*columns, F.lit(True).alias("whole"), (F.col("pg_start") + F.col("i1")).alias("pg_offset_ref"))
    # segments of too few anchors
    few = told.filter("hunks is null").select(book, "segment_id")
    parts = pages.segments(alignments, book, "scan_page").join(few, [book, "segment_id"])
    nr = F.row_number().over(Window.partitionBy(book, "segment_id").orderBy("scan_page", "pg_start", "pg_end"))
    said = own.select(book, F.col(page).alias("scan_page"), F.coalesce(F.col(text), F.lit("")).alias("page_text")).filter("page_text <> ''")
    pairs = parts.withColumn("nr", nr).join(said, [book, "scan_page"]).join(books.select(book, "body_text"), book)
    passage = F.substring("body_text", (F.col("pg_start") + 1).cast("int"), (F.col("pg_end") - F.col("pg_start")).cast("int"))
    keys = [book, "segment_id", "nr", "scan_page", "pg_start"]
    flat = diff.candidates(diff.hunks(pairs.select(*keys, passage.alias("a_text"), "page_text"), keys, "a_text", "page_text", "flat"))
    flat = flat.withColumn("seq", (F.col("nr") * 1_000_000 + F.col("seq")).cast("int")).withColumn("scan_page", F.col("scan_page").cast("long"))
    return placed.unionByName(flat.select(*columns, F.lit(False).alias("whole"), (F.col("pg_start") + F.col("i1")).alias("pg_offset_ref")))

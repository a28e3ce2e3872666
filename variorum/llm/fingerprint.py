"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

For each of the samples a term has r, c ~ Gamma(2, 1) and b ~ U(0, 1), all functions
of a hash of the term and the sample's number. A term of weight w takes the level
t = floor(ln w / r + b) and the value ln a = ln c - r (t - b + 1); the term and level
of least value are the sample (Ioffe, 2010). Two documents have the same sample with
a probability that is the generalised Jaccard similarity of their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.runtime import cut, parallelism

SAMPLES = 40
SPAN = 1024
#: as many spans one task puts in order
ONE_TASK_ROWS = 100_000


#: The logarithm that stands for no occurrence: it can't be least, and stays within a long.
ABSENT = -1e6


def _samples(term: str, ln_weights: list[str], n: int) -> list[list[Column]]:
    """For each weight and sample a long whose least over the terms has the sample in its low 16 bits.

    Gamma(2, 1) is the negative logarithm of a product of two uniforms; each is 21
    bits of one of two hashes of the term and the sample's number. All weights of a
    term share them.
    """
    bits = (1 << 21) - 1
    out: list[list[Column]] = [[] for _ in ln_weights]
    for k in range(n):
        z = F.xxhash64(F.col(term), F.lit(k))
        y = F.xxhash64(z)

        def uniform(h: Column, at: int) -> Column:
            return (F.shiftright(h, at).bitwiseAND(bits) + 0.5) / float(1 << 21)

        r = -F.log(uniform(z, 0) * uniform(z, 21))
        ln_c = F.log(-F.log(uniform(y, 0) * uniform(y, 21)))
        b = uniform(y, 42)
        for found, ln_weight in zip(out, ln_weights, strict=True):
            t = F.floor(F.col(ln_weight) / r + b)
            value = ln_c - r * (t - b + 1)
            name = F.shiftright(z, 44).bitwiseXOR(t * 40503).bitwiseAND(0xFFFF)
            found.append(F.shiftleft(((value + 128.0) * float(1 << 24)).cast("long"), 16).bitwiseOR(name))
    return out


def _hashed_words(text: Column) -> Column:
    words = F.split(F.translate(F.lower(text), "\t\n\x0b\f\r", "     "), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _signed(counted: DataFrame, keys: list[str], weights: list[str], samples: int, figures: list[str] | None = None) -> DataFrame:
    """(keys, a signature named after each weight, figures) of (keys, term, weights).

    A signature has 4 hex digits per sample and is empty without weight. With figures
    there is a column kind, 0 for terms; a row of kind k has no weight, and the value
    of the k-th figure for its term.
    """
    logs = [F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).otherwise(ABSENT).alias(f"ln_{w}") for w in weights]
    found = _samples("term", [f"ln_{w}" for w in weights], samples)
    least = [F.min(x).alias(f"{w}_{k}") for w, own in zip(weights, found, strict=True) for k, x in enumerate(own)]
    told = [F.max(F.when(F.col("kind") == k, F.col("term"))).alias(c) for k, c in enumerate(figures or [], 1)]
    least = counted.select("*", *logs).groupBy(*keys).agg(*told, *(F.max(w).alias(w) for w in weights), *least)

    def signature(w: str) -> Column:
        return F.when(F.col(w) > 0, F.concat(*(F.lpad(F.lower(F.hex(F.col(f"{w}_{k}").bitwiseAND(0xFFFF))), 4, "0") for k in range(samples)))).otherwise("")

    return least.select(*keys, *(signature(w).alias(w) for w in weights), *(figures or []))


def signatures(texts: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, signature) of each text's words, weighted by how often they occur.

    keys tell the rows of texts apart. Words are runs of anything but ASCII white
    space, in lower case; a text without words has no row.
    """
    terms = texts.select(*keys, F.explode(_hashed_words(F.col(text_col))).alias("term"))
    return _signed(terms.groupBy(*keys, "term").agg(F.count("*").alias("signature")), keys, ["signature"], samples)


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two signature columns; 1 for two empty ones, 0 for one."""
    same = F.expr(f"size(filter(sequence(0, {samples - 1}), i -> substring({a}, i * 4 + 1, 4) = substring({b}, i * 4 + 1, 4)))") / float(samples)
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(same)


def _before(spans: DataFrame, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """(span, before): the next lower of distinct spans, for the lowest one the highest.

    Up to one_task spans are put in one order; more are dealt into SPAN neighbouring
    ones, and what is before their lowest is found among the parts in the same way
    (one_task is 2 at least).
    """
    if spans.count() <= one_task:
        order = Window.orderBy("span")
        last = F.max("span").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return spans.select("span", F.coalesce(F.lag("span").over(order), last).alias("before"))
    own = cut(spans.withColumn("part", F.floor(F.col("span") / SPAN).cast("long")))
    highest = own.groupBy("part").agg(F.max("span").alias("highest"))
    parts = _before(highest.select(F.col("part").alias("span")), one_task).toDF("part", "lower")
    edges = parts.join(highest.withColumnRenamed("part", "lower"), "lower").select("part", "highest")
    near = F.lag("span").over(Window.partitionBy("part").orderBy("span"))
    return own.withColumn("near", near).join(edges, "part").select("span", F.coalesce("near", "highest").alias("before"))


def with_next(docs: DataFrame, id_col: str, text_col: str, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """(span, place, end, id, text, next_text): each row with the text of the next by descending id, after the last the first.

    Rows are dealt by ranges of SPAN ids; at a range's end stands a row with `end`,
    which has the first text of the next range. Texts travel once, and a range's
    first text once more. Null texts are empty. Ties of the id are in the order of
    their texts; null ids are a range after all others. Rows of one id, and those of
    null ids, are one range, however many there are.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("span", F.coalesce(F.floor(F.col("id") / SPAN), F.lit(-(1 << 62))).cast("long"))
    firsts = cut(own.groupBy("span").agg(F.min(F.struct(F.expr("~id"), "text"))["text"].alias("text")))
    follows = _before(firsts.select("span"), one_task).toDF("at", "span")
    ends = firsts.join(follows, "span").select(F.lit(None).cast("long").alias("id"), "text", F.col("at").alias("span"), F.lit(True).alias("end"))
    rows = own.withColumn("end", F.lit(False)).unionByName(ends).repartition(max(parallelism(docs.sparkSession), firsts.count() // 2), "span")
    within = Window.partitionBy("span").orderBy(F.col("end"), F.col("id").desc_nulls_last(), F.col("text"))
    return rows.select("span", "end", "id", "text", F.row_number().over(within).alias("place"), F.lead("text").over(within).alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id_col, fingerprint): the signature of each text, empty for one without words.

    Null texts are empty. Repeated rows give repeated rows. Texts travel once, to
    be told apart; their terms stay where they are.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
    one = own.select("key", "text").dropDuplicates(["key"])
    found = signatures(one, ["key"], "text", samples)
    return own.join(found, "key", "left").select(F.col("id").alias(id_col), F.coalesce("signature", F.lit("")).alias("fingerprint"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like they and the next document's are.

    The edited text has the first characters of the next document, by descending
    id, for its last third. See with_next for nulls, ties and repeated rows.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.coalesce(F.substring("next_text", F.lit(1), third), F.lit(""))))
    # a document's words and its figures leave its texts behind together, so that these
    # are dealt out once; a term of both texts is drawn for once
    sha = F.sha2("edited", 256)
    words32 = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    figures = {"id": F.col("id"), "n_chars": n.cast("long")} | {f"sha_{i}": F.shiftleft(words32[2 * i], 32).bitwiseOR(words32[2 * i + 1]) for i in range(4)}
    lists = [(0, 1, 0, _hashed_words(F.col("text"))), (0, 0, 1, _hashed_words(F.col("edited"))), *((k, 0, 0, F.array(v)) for k, v in enumerate(figures.values(), 1))]
    parts = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(own).alias("own"), F.lit(other).alias("other"), terms.alias("terms")) for kind, own, other, terms in lists))
    kept = F.when(F.col("end"), F.slice(parts, 1, 1)).otherwise(parts)
    terms = rows.select("span", "place", F.explode(kept).alias("x")).select("span", "place", "x.kind", "x.own", "x.other", F.explode("x.terms").alias("term"))
    counted = terms.groupBy("span", "place", "kind", "term").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    signed = _signed(counted, ["span", "place"], ["own", "other"], samples, list(figures))
    following = F.coalesce(F.lead("own").over(Window.partitionBy("span").orderBy("place")), F.lit(""))
    edited = F.concat(*(F.lpad(F.lower(F.hex(f"sha_{i}")), 16, "0") for i in range(4)))
    joined = signed.withColumn("following", following).filter("n_chars is not null")
    return joined.select(F.col("id").alias(id_col), "n_chars", edited.alias("edited_sha256"), F.col("own").alias("fingerprint"), F.col("other").alias("edited_fingerprint"), likeness("own", "other", samples).alias("near_edited"), likeness("own", "following", samples).alias("near_next"))

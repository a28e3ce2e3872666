"""Whether a text and a scan are of one edition: clues, line breaks, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T

# fixed values: points of the metadata score and its limits
PUBLISHER, YEAR, TITLE, CITY, FIRST = 40, 30, 10, 10, 10
MATCH, POSSIBLE = 70, 40


def _either_holds(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def metadata_score(rows: DataFrame) -> DataFrame:
    """Score and result of rows with pg_ and ia_ publisher, year, title, city and first edition; null is empty."""

    def c(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    publisher = _either_holds(T.normalize_publisher(c("pg_publisher")), T.normalize_publisher(c("ia_publisher")))
    years = T.year(c("pg_year")), T.year(c("ia_date"))
    year = F.coalesce(F.abs(years[0] - years[1]) <= 2, F.lit(False))
    title = T.title_similarity(c("pg_title"), c("ia_title")) > 0.7
    city = _either_holds(F.trim(F.lower(c("pg_city"))), F.trim(F.lower(c("ia_city"))))
    first = F.coalesce(F.col("pg_first"), F.lit(False)) & F.lower(c("ia_description")).contains("first edition")
    known = ((F.trim(c("pg_publisher")) != "") & (F.trim(c("ia_publisher")) != "")) | (years[0].isNotNull() & years[1].isNotNull())
    points = sum(F.when(test, n).otherwise(0) for test, n in ((publisher, PUBLISHER), (year, YEAR), (title, TITLE), (city, CITY), (first, FIRST)))
    out = rows.withColumn("score", points)
    result = F.when((F.col("score") == 0) | ~known, "unable_to_determine").when(F.col("score") >= MATCH, "match").when(F.col("score") >= POSSIBLE, "possible").otherwise("mismatch")
    return out.withColumn("result", result)


def overall(a: Column, a_score: Column, b: Column, b_confidence: Column) -> tuple[Column, Column]:
    """Result and confidence of both approaches; an approach that wasn't run is null."""
    says = lambda c: c.isin("match", "mismatch")
    agree = says(a) & (a == b)
    lone = F.when(a.isNull(), b).when(b.isNull(), a)
    result = (
        F.when(lone.isNotNull() | (a.isNull() & b.isNull()), F.when(says(lone), lone).otherwise("unable_to_determine"))
        .when(says(a), a)
        .when(says(b), b)
        .otherwise("unable_to_determine")
    )
    confidence = (
        F.when(lone.isNotNull(), F.when(says(lone), 0.5).otherwise(0.0))
        .when(a.isNull() & b.isNull(), 0.0)
        .when(agree & (a == "match"), F.greatest(F.lit(0.8), (a_score / 100.0 + b_confidence) / 2))
        .when(agree, F.greatest(F.lit(0.6), a_score / 100.0, b_confidence))
        .when(says(b) & (a == "unable_to_determine"), b_confidence)
        .when(says(a) & (b == "unable_to_determine"), a_score / 100.0)
        .when(says(a) | says(b), 0.6)
        .otherwise(0.0)
    )
    return result, confidence


def line_profile(docs: DataFrame, key: str = "doc_id", text: str = "text", most_lines: int | None = 2000) -> DataFrame:
    """Per text the modal length of its long lines, the share near it, and whether breaks are preserved.

    By the rule the first most_lines lines of more than 40 characters count, with None
    all of them; of equally frequent lengths the one seen first comes first.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).filter("trim(line) <> '' and length(line) > 40").select(key, "pos", F.length("line").alias("width"))
    if most_lines is not None:
        lines = lines.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("rank") <= most_lines)
    counts = lines.groupBy(key, "width").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), "first")
    ranked = counts.withColumn("rank", F.row_number().over(order)).withColumn("modal", F.first("width").over(order))
    top = F.when(F.col("rank") <= 3, F.col("width"))
    out = ranked.groupBy(key).agg(F.first("modal").alias("modal"), F.sum("n").alias("lines"), F.sum(F.when(F.abs(F.col("width") - F.col("modal")) <= 5, F.col("n")).otherwise(0)).alias("near"), (F.max(top) - F.min(top)).alias("spread"))
    return out.withColumn("preserved", (F.col("near") / F.col("lines") > 0.5) & (F.col("spread") <= 5))


def line_endings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, word): the last words of the non-blank lines, without closing marks, in order."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).filter("trim(line) <> ''")
    word = F.lower(F.regexp_replace(F.element_at(T.tokens(F.trim("line")), -1), r"[.,;:!?\"']+$", ""))
    own = lines.select(key, "pos", word.alias("word")).filter("word <> ''")
    return own.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("long").alias("idx"), "word")


def matching_endings(pairs: DataFrame, endings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(a_id, b_id, total, matched): lines of a with an equal ending at about the same place in b; each counts once.

    Places are dealt into bins as wide as a pair's tolerance, so that a word that ends
    many lines meets those near by alone.
    """
    a = pairs.join(endings.toDF("a_id", "a_idx", "word"), "a_id")
    sizes = a.groupBy("a_id", "b_id").agg(F.count("*").alias("total"))
    b = pairs.join(endings.toDF("b_id", "b_idx", "word"), "b_id").join(sizes, ["a_id", "b_id"])
    wide = F.greatest(F.lit(5.0), F.col("total") * 0.1)
    dealt = b.withColumn("bin", F.floor(F.col("b_idx") / wide)).withColumn("bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)))
    own = a.join(sizes, ["a_id", "b_id"]).withColumn("bin", F.floor(F.col("a_idx") / wide))
    near = own.join(dealt.drop("total"), ["a_id", "b_id", "word", "bin"]).filter(F.abs(F.col("a_idx") - F.col("b_idx")) <= wide)
    hits = near.select("a_id", "b_id", "a_idx").distinct().groupBy("a_id", "b_id").agg(F.count("*").alias("matched"))
    return sizes.join(hits, ["a_id", "b_id"], "left").fillna(0, ["matched"])


def line_break_result(col_a: Column, col_b: Column, endings: Column, sequence: Column) -> tuple[Column, Column]:
    """Result and confidence; the column width weighs most and vetoes by itself (Q17)."""
    apart = F.abs(col_a - col_b)
    total = F.greatest(F.lit(0.0), 1 - apart / F.greatest(col_a, col_b)) * 0.5 + endings * 0.3 + sequence * 0.2
    result = F.when(apart > 5, "mismatch").when(total >= 0.6, "match").when(total >= 0.3, "possible").otherwise("mismatch")
    return result, F.when(apart > 5, F.least(total, F.lit(0.4))).otherwise(total)


def clues(header: Column) -> dict[str, Column]:
    """What a text's header says of its edition: publisher, city, year, first edition, source scan, producer."""
    line = F.trim(F.regexp_extract(header, r"(?i)(?:Edition:?\s*)?Published by[:\s]+([^\n]+)", 1))
    place, house = (F.regexp_extract(line, r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*[,:]\s*(.+)", k) for k in (1, 2))
    placed = (place != "") & (F.length(place) < 20)
    publisher = F.when(placed, F.trim(house)).otherwise(line)
    dated = F.regexp_extract(header, r"(?i)(?:Copyright|Published|Edition|Printed)\s+(?:in\s+)?([0-9]{4})", 1)
    return {
        "pg_publisher": publisher,
        "pg_city": F.when(placed, F.trim(place)).otherwise(F.lit("")),
        "pg_year": F.when(dated != "", dated).otherwise(F.regexp_extract(publisher, r"([0-9]{4})", 1)),
        "pg_first": header.rlike(r"(?i)first\s+edition"),
        "pg_source_scan": F.regexp_extract(header, r"(?i)Source\s*:\s*https?://archive\.org/details/([^\s/\"]+)", 1),
        "pg_producer": F.trim(F.regexp_extract(header, r"(?m)^Produced by[:\s]+(.+)", 1)),
    }

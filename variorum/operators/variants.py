"""Textual variants between two editions: category and significance, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import lexicon
from variorum.functions import text as T
from variorum.functions.text import plain_words, squeeze, strip_punctuation

ORDINAL = {"major": 0, "moderate": 1, "minor": 2, "trivial": 3}


def _absent(a: Column, b: Column) -> Column:
    return a.contains("(absent in") | b.contains("(absent in")


def category(a: Column, b: Column) -> Column:
    """M30."""
    x, y = plain_words(a), plain_words(b)
    same = F.size(x) == F.size(y)
    key = lambda p, q: lexicon.is_us_uk(p, q)
    changed = F.filter(F.arrays_zip(x.alias("p"), y.alias("q")), lambda z: F.lower(z["p"]) != F.lower(z["q"]))
    spelled = same & (F.size(changed) > 0) & F.forall(changed, lambda z: key(z["p"], z["q"]))
    broken = (squeeze(T.dehyphenate(a)) == squeeze(T.dehyphenate(b))) & (a.rlike(r"\b\w-\s*\n") | b.rlike(r"\b\w-\s*\n"))
    return (
        F.when(a.contains("(absent in PG)"), "added_content")
        .when(_absent(a, b), "missing_content")
        .when(squeeze(a) == squeeze(b), "normalization")
        .when((strip_punctuation(a) == strip_punctuation(b)) & (strip_punctuation(a) != ""), "punctuation_variant")
        .when(spelled, "spelling_change")
        .when(broken, "linebreak_variant")
        .otherwise("textual_variant")
    )


def negation_changed(a: Column, b: Column) -> Column:
    """X3."""
    known = F.array(*map(F.lit, lexicon.NEGATIONS))

    def of(c: Column) -> Column:
        return F.array_sort(F.array_intersect(F.array_distinct(plain_words(F.lower(c))), known))

    return of(a) != of(b)


def content_changes(a: Column, b: Column) -> Column:
    """Content words of one side only."""
    x, y = (F.array_distinct(plain_words(F.lower(c))) for c in (a, b))
    common = F.array(*map(F.lit, lexicon.FUNCTION_WORDS))
    return F.size(F.array_except(F.array_except(x, y), common)) + F.size(F.array_except(F.array_except(y, x), common))


def significance(a: Column, b: Column, kind: Column) -> Column:
    """M31 to M34."""
    present = F.size(plain_words(F.when(a.contains("(absent in"), b).otherwise(a)))
    marks = F.array(*map(F.lit, ".!?;:"))
    x, y = (F.array_distinct(F.split(c, "")) for c in (a, b))
    differ = F.array_union(F.array_except(x, y), F.array_except(y, x))
    n = content_changes(a, b)
    by_size = F.when(present == 0, "trivial").when(present <= 2, "minor").when(present <= 10, "moderate").otherwise("major")
    by_words = (
        F.when((F.size(plain_words(a)) == 0) & (F.size(plain_words(b)) == 0), "trivial")
        .when(negation_changed(a, b), "major")
        .when(n == 0, "minor")
        .when(n >= 3, "major")
        .otherwise("moderate")
    )
    return (
        F.when(kind.isin("normalization", "linebreak_variant", "formatting_variant"), "trivial")
        .when(kind == "spelling_change", "minor")
        .when(kind == "punctuation_variant", F.when(F.size(F.array_intersect(differ, marks)) > 0, "moderate").otherwise("minor"))
        .when(_absent(a, b), by_size)
        .otherwise(by_words)
    )


def classify(cands: DataFrame) -> DataFrame:
    """Category and significance of each candidate; null texts are empty."""
    a, b = F.coalesce("pg_text", F.lit("")), F.coalesce("scan_text", F.lit(""))
    return cands.withColumn("variant", category(a, b)).withColumn("significance", significance(a, b, F.col("variant")))


def at_least(found: DataFrame, level: str) -> DataFrame:
    """variants of this significance or more."""
    order = F.element_at(F.create_map(*(F.lit(x) for kv in ORDINAL.items() for x in kv)), F.col("significance"))
    return found.filter(order <= ORDINAL[level])


def summary(found: DataFrame) -> DataFrame:
    """Counts by category, by significance, by both and in all."""
    cube = found.cube("variant", "significance").agg(F.count("*").alias("n"))
    return cube.select(F.coalesce("variant", F.lit("(all)")).alias("variant"), F.coalesce("significance", F.lit("(all)")).alias("significance"), "n")


def chapter_rollup(found: DataFrame, chapter: str = "chapter", page: str = "scan_page", seq: str = "seq") -> DataFrame:
    """Per chapter its pages, first variant, and counts by significance."""
    counts = [F.count_if(F.col("significance") == s).alias(s) for s in ORDINAL]
    return found.groupBy(chapter).agg(F.min(seq).alias("first_seq"), F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("n"), *counts)


def top(found: DataFrame, level: str, n: int = 50) -> DataFrame:
    """The first n variants of a level, with how many there are."""
    own = found.filter(F.col("significance") == level)
    rank = F.row_number().over(Window.partitionBy("significance").orderBy("item_id", "seq"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= n)

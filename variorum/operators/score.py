"""Scores of candidates, replacements that recur, and what is kept of near repetitions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import lexicon
from variorum.functions import text as T
from variorum.operators.dictionary import diacritic_change

# fixed values: the weights of the score's parts, and the verdicts' limits
CONTEXT, EDIT, ALIGN, LENGTH = 0.45, 0.20, 0.20, 0.15
SURE, OPEN = 0.8, 0.5
#: fixed values: characters trimmed off both sides alike, and quotes that count as alike
EDGE = "'\";:,.!?()[]*—– ‘’“”"


def _steps(x: Column, *steps: tuple[float, float], last: float) -> Column:
    out = F.when(x >= steps[0][0], steps[0][1])
    for limit, value in steps[1:]:
        out = out.when(x >= limit, value)
    return out.otherwise(last)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a value that is worked out once a row: the optimizer doesn't put its expression in place of its uses."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def find_near(text: Column, word: Column, offset: Column) -> Column:
    """Where the word stands within 50 characters of offset, by letter or by case; -1 for nowhere."""
    start = F.greatest(F.lit(0), offset - 50)
    region = F.substring(text, (start + 1).cast("int"), (offset + F.length(word) + 50 - start).cast("int"))
    places = F.transform(F.array(F.struct(start.alias("s"), region.alias("r"))), lambda x: F.struct(x["s"].alias("s"), F.instr(x["r"], word).alias("exact"), F.instr(F.lower(x["r"]), F.trim(F.lower(word))).alias("folded")))
    return F.transform(places, lambda x: F.when(x["exact"] > 0, x["s"] + x["exact"] - 1).when(x["folded"] > 0, x["s"] + x["folded"] - 1).otherwise(-1))[0]


def _context_score(near: Column, b: Column) -> Column:
    """M6: the share of the witness's longer words among the words near by, in steps."""
    words = F.filter(T.tokens(F.lower(b)), lambda w: F.length(w) >= 3)
    hits = F.size(F.filter(words, lambda w: F.array_contains(near, w) | F.array_contains(near, F.regexp_replace(w, r"[.,;:!?\"']+$", ""))))
    return F.when(F.size(words) == 0, 0.0).otherwise(_steps(hits / F.size(words), (0.8, 1.0), (0.6, 0.8), (0.4, 0.5), (0.2, 0.3), last=0.0))


def edit_score(a: Column, b: Column) -> Column:
    """M7 for single words: their edit distance over the longer, in steps; null for several words."""
    x, y = (F.regexp_replace(F.trim(F.lower(c)), r"[.,;:!?\"'()\[\]{}]", "") for c in (a, b))
    far = F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    one = (F.size(T.tokens(x)) == 1) & (F.size(T.tokens(y)) == 1)
    return F.when((x == "") | (y == ""), 0.0).when(one, F.when(far == 0, 1.0).when(far <= 0.2, 0.9).when(far <= 0.4, 0.7).when(far <= 0.6, 0.4).otherwise(0.1))


def edit_score_any(a: Column, b: Column) -> Column:
    """M7: edit_score, and for several words the similarity of their sequences, in steps, by an Arrow function."""

    @F.pandas_udf("double")
    def alike(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, (x or "").split(), (y or "").split()).ratio() for x, y in zip(p, q, strict=True)])

    x, y = (F.regexp_replace(F.trim(F.lower(c)), r"[.,;:!?\"'()\[\]{}]", "") for c in (a, b))
    several = _steps(alike(x, y), (0.7, 0.9), (0.5, 0.6), (0.3, 0.3), last=0.1)
    return F.coalesce(edit_score(a, b), several)


def alignment_score(confidence: Column) -> Column:
    """M8."""
    return F.when(confidence.isNull(), 0.3).otherwise(_steps(confidence, (0.9, 1.0), (0.7, 0.8), (0.5, 0.5), last=0.2))


def length_score(a: Column, b: Column) -> Column:
    """M9."""
    n, m = F.length(F.trim(a)), F.length(F.trim(b))
    return F.when((n == 0) | (m == 0), 0.3).otherwise(_steps(F.least(n, m) / F.greatest(n, m), (0.8, 1.0), (0.6, 0.7), (0.4, 0.4), last=0.1))


def with_score(rows: DataFrame, text: str, offset: str, confidence: str, edit: Column | None = None) -> DataFrame:
    """M5: rows (pg_text, scan_text, and the named columns) with `score`, null where the edit score is, by default that of single words.

    A lone word that is close to the other isn't held to its context. The words
    within 300 characters are a column of their own, made once a row.
    """
    a, b = F.col("pg_text"), F.col("scan_text")
    own = once(rows, "__found", find_near(F.col(text), a, F.col(offset)))
    own = once(own, "__at", F.when(F.col("__found") < 0, F.col(offset)).otherwise(F.col("__found"))).withColumn("__start", F.greatest(F.lit(0), F.col("__at") - 300))
    near = F.substring(F.col(text), (F.col("__start") + 1).cast("int"), (F.col("__at") + F.length(a) + 300 - F.col("__start")).cast("int"))
    own = once(own, "__near", T.tokens(F.lower(near)))
    own = once(own, "__context", _context_score(F.col("__near"), b))
    x, y = (F.lower(F.regexp_replace(F.trim(c), r"^[.,;:!?\"'“”]+|[.,;:!?\"'“”]+$", "")) for c in (a, b))
    alone = F.size(F.filter(T.tokens(b), lambda w: F.length(w) >= 3)) <= 1
    close = (F.length(x) > 2) & (F.length(y) > 2) & (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)) >= 0.5)
    context = F.when(alone & (F.col("__context") == 0.0) & close, 0.5).otherwise(F.col("__context"))
    own = own.withColumn("__edit", edit_score(a, b) if edit is None else edit)
    total = context * CONTEXT + F.col("__edit") * EDIT + alignment_score(F.col(confidence)) * ALIGN + length_score(a, b) * LENGTH
    scored = own.withColumn("score", F.when(a.contains("(absent") | b.contains("(absent"), 0.0).otherwise(total))
    return scored.drop("__found", "__at", "__start", "__near", "__context", "__edit")


def verdict(total: Column) -> Column:
    """M3."""
    return F.when(total >= SURE, "scan_correct").when(total >= OPEN, "ambiguous").otherwise("unable_to_verify")


def buckets(scored: DataFrame, total: str = "score") -> DataFrame:
    """G6, F46 to F48."""
    c = F.col(total)
    return scored.agg(F.count_if(c >= SURE).alias("high"), F.count_if((c >= OPEN) & (c < SURE)).alias("medium"), F.count_if(c < OPEN).alias("low"))


_ALIKE = str.maketrans("‘’“”", "''\"\"")


def _trimmed(a: str, b: str) -> tuple[str, str]:
    x, y = a, b
    for _ in range(2):  # from the start, then, reversed, from the end
        k = 0
        while k < min(len(x), len(y)) and x[k] in EDGE and y[k] in EDGE and x[k].translate(_ALIKE) == y[k].translate(_ALIKE):
            k += 1
        x, y = x[k:][::-1], y[k:][::-1]
    return (x, y) if x and y else (a, b)


def trim_shared_edges(a: Column, b: Column) -> Column:
    """struct(x, y), both sides without the punctuation that they share at their ends, unless nothing would be left.

    How far to trim depends on what was trimmed, so this is an Arrow function.
    """

    @F.pandas_udf("x string, y string")
    def trim(p: pd.Series, q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_trimmed(x or "", y or "") for x, y in zip(p, q, strict=True)], columns=["x", "y"])

    return trim(a, b)


def replacement_pairs(cands: DataFrame) -> DataFrame:
    """G9, its first half: word-level pairs with roots; page and rows that don't change are kept out."""
    a, b = F.trim("pg_text"), F.trim("scan_text")
    near = cands.filter((a != "") & (b != "") & (F.abs(F.length(a) - F.length(b)) <= 50))
    near = near.withColumn("__t", trim_shared_edges(F.trim("pg_text"), F.trim("scan_text"))).withColumns({"x": F.col("__t.x"), "y": F.col("__t.y")}).drop("__t")
    straight = [F.translate(c, "‘’", "''") for c in ("x", "y")]
    letters = [F.regexp_replace(c, "[^a-zA-Z]", "") for c in ("x", "y")]
    near = near.filter((F.length("x") <= 30) & (F.length("y") <= 30) & (straight[0] != straight[1]) & (letters[0] != letters[1]) & ~(F.col("y").rlike("[*†‡]") & ~F.col("y").rlike("[a-zA-Z]{3,}")))
    near = near.filter((F.size(T.tokens(F.col("x"))) <= 2) & (F.size(T.tokens(F.col("y"))) <= 2) & (F.abs(F.length("x") - F.length("y")) <= 5))
    roots = [T.normalize_possessive(F.regexp_replace(F.trim(c), "^[\"'“”]+|[\"'“”]+$", "")) for c in ("x", "y")]
    near = near.withColumn("pg_root", roots[0]).withColumn("scan_root", roots[1])
    return near.filter("pg_root <> '' and scan_root <> '' and pg_root <> scan_root and not contains(pg_root, ' ') and not contains(scan_root, ' ')")


def global_replacements(cands: DataFrame, words: DataFrame, page: str = "item_id", least: int = 2) -> DataFrame:
    """(pg_root, scan_root, caught, occurrences, pages) of replacements whose word the base text has often enough.

    words is a table of the base text's words (word); occurrences are counted by
    grouping it. A capitalised replacement needs one occurrence (Q24), and so does one
    that changes accents and ligatures alone.
    """
    pairs = replacement_pairs(cands).groupBy("pg_root", "scan_root").agg(F.count("*").alias("caught"), F.array_sort(F.collect_set(page)).alias("pages"))
    counts = words.groupBy(F.col("word").alias("pg_root")).agg(F.count("*").alias("occurrences"))
    capital = F.substring("scan_root", 1, 1).rlike(r"\p{Lu}")
    accents = diacritic_change(F.col("pg_root"), F.col("scan_root"))
    return pairs.join(counts, "pg_root").filter(F.col("occurrences") >= F.when(capital | accents, 1).otherwise(least))


def promoted(errors: DataFrame, books: DataFrame, known: DataFrame) -> DataFrame:
    """Single-word errors whose scan has an accent or ligature, as further rows of global_replacements, which `known` has.

    The base text is searched for the word in either case, within longer words too.
    A pair of words counts once a book, as its first error has it, without pages.
    """
    raw = [F.lower(F.coalesce(c, F.lit(""))) for c in ("pg_text", "scan_text")]
    clean = [F.trim(F.regexp_replace(c, "<[^>]+>", "")) for c in ("pg_text", "scan_text")]
    own = errors.filter(lexicon.has_mark(F.col("scan_text")) & ~F.trim("pg_text").contains(" ") & ~F.trim("scan_text").contains(" ")).withColumns({"a": raw[0], "b": raw[1], "x": clean[0], "y": clean[1]})
    own = own.join(known.select(F.lower("pg_root").alias("a"), F.lower("scan_root").alias("b")).distinct(), ["a", "b"], "left_anti").filter("length(x) >= 2")
    first = own.groupBy("book_id", F.lower("x").alias("a"), F.lower("y").alias("b")).agg(F.min(F.struct("scan_page", "seq", "x", "y")).alias("e"))
    body = F.lower("body_text")
    times = (F.length(body) - F.length(F.replace(body, F.col("a"), F.lit("")))) / F.length("a")
    found = first.join(books.select("book_id", "body_text"), "book_id").select("book_id", "a", "b", "e", times.cast("long").alias("n")).filter("n > 0")
    out = found.groupBy("a", "b").agg(F.min_by("e", "book_id").alias("e"), F.count("*").alias("caught"), F.sum("n").alias("occurrences"))
    return out.select(F.col("e.x").alias("pg_root"), F.col("e.y").alias("scan_root"), "caught", "occurrences", F.array().cast(known.schema["pages"].dataType).alias("pages"))


def dedup_exact(scored: DataFrame, keys: list[str], offset: str = "pg_offset", total: str = "score") -> DataFrame:
    """W11, its first half: the best row at an offset."""
    w = Window.partitionBy(*keys, offset).orderBy(F.col(total).desc_nulls_last(), "seq")
    return scored.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def dedup_near(scored: DataFrame, keys: list[str], offset: str = "pg_offset", within: int = 50) -> DataFrame:
    """W11, its second half: of equal text pairs the rows at least `within` characters after the last one kept.

    The fold runs per text pair and key; groups are one book's repetitions of one pair.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([offset, "seq"])
        kept, last = [], None
        for at in rows[offset]:
            keep = last is None or at - last >= within
            kept.append(keep)
            last = at if keep else last
        return rows[kept]

    return scored.groupBy(*keys, "pg_text", "scan_text").applyInPandas(fold, scored.schema)


def page_stats(cands: DataFrame, page: str = "item_id") -> DataFrame:
    """Totals, average, upper median and maximum of the rows per page.

    Pages are counted by their number of rows; only these counts, of which there are
    no more than the square root of twice the rows, come together.
    """
    per = cands.groupBy(page).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("m"))
    up_to = F.sum("m").over(Window.orderBy("n"))
    every = F.sum("m").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = per.withColumn("up_to", up_to).withColumn("middle", F.floor(every / 2))
    return placed.agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("pages"), (F.sum(F.col("n") * F.col("m")) / F.sum("m")).alias("average"), F.min(F.when(F.col("up_to") > F.col("middle"), F.col("n"))).alias("median"), F.max("n").alias("most"))


def noisiest(cands: DataFrame, page: str = "item_id", k: int = 10) -> DataFrame:
    """The k pages with most rows, ties by page."""
    return cands.groupBy(page).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), page).limit(k)

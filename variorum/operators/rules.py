"""False-positive rules, artefact filters and report filters of differences, as ordered column expressions.

Every filter takes the columns of the base text's side (a) and the witness's side (b).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import lexicon
from variorum.functions import text as T

# fixed values: pairs of patterns of modernised forms, and of editorial variants (Q4: some ask for a space before)
MODERNISED = (
    (r"\bshan't\b", r"\bshall not\b"),
    (r"\bcan't\b", r"\bcannot\b"),
    (r"\bdon't\b", r"\bdo not\b"),
    (r"\bdidn't\b", r"\bdid not\b"),
    (r"\bwon't\b", r"\bwill not\b"),
    (r"'twas", r"it was"),
    (r"'tis", r"it is"),
    (r"\bsome one\b", r"\bsomeone\b"),
    (r"\bany one\b", r"\banyone\b"),
    (r"\bevery one\b", r"\beveryone\b"),
    (r"\bto-morrow\b", r"\btomorrow\b"),
    (r"\bto-night\b", r"\btonight\b"),
    (r"\bto-day\b", r"\btoday\b"),
    (r"\balways\b", r"\bal ways\b"),
    (r"\bupon\b", r"\bon\b"),
)
EDITORIAL = (
    (r"\bcolour\b", r"\bcolor\b"),
    (r"\bfavour\b", r"\bfavor\b"),
    (r"\b honour\b", r"\bhonor\b"),
    (r"\b rumour\b", r"\brumor\b"),
    (r"\bbehaviour\b", r"\bbehavior\b"),
    (r"\bcentre\b", r"\bcenter\b"),
    (r"\b defence\b", r"\bdefense\b"),
    (r"\btravelling\b", r"\btraveling\b"),
    (r"\b amongst\b", r"\b among\b"),
    (r"\b whilst\b", r"\b while\b"),
    (r"\b towards\b", r"\b toward\b"),
    (r"\b forwards\b", r"\b forward\b"),
    (r"\bdownright\b", r"\bdown-right\b"),
    (r"\baback\b", r"\ba-back\b"),
    (r"\bsomehow\b", r"\bsome-how\b"),
    (r"\banyhow\b", r"\bany-how\b"),
    (r"\beverywhere\b", r"\bevery-where\b"),
    (r"\bsomething\b", r"\bsome-thing\b"),
    (r"\bnothing\b", r"\bno-thing\b"),
    (r":", r";"),
)
# fixed values: the forms of typographic conversions, looked for at the start of either side (Q3)
TYPOGRAPHY_A, TYPOGRAPHY_B = r"^(--$| -+ |\"$|'$|’)", r"^(—$| — |[“”]$|[‘’]$|')"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests)


def _either_way(a: Column, b: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return _any([(a.rlike(p) & b.rlike(q)) | (a.rlike(q) & b.rlike(p)) for p, q in pairs])


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")


def verdict(a: Column, b: Column, category: Column) -> Column:
    """struct(fp, reason, new_category) of the first rule that applies."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))

    def says(fp: bool, reason: str, new: str | None = None) -> Column:
        return F.struct(F.lit(fp).alias("fp"), F.lit(reason).alias("reason"), F.lit(new).cast("string").alias("new_category"))

    same = (_bare(x) == _bare(y)) & ~F.concat(x, F.lit(" "), y).rlike(r"[a-z]\.[a-z]") & (category != "punctuation_diff")
    unbroken = F.regexp_replace(x, rf"({T.W})-\s*", "$1") == F.regexp_replace(y, rf"({T.W})-\s*", "$1")
    return (
        F.when(y.contains("(absent in pg)") | y.contains("(absent in scan)"), says(False, "artifact", "alignment_artifact"))
        .when(x.rlike(TYPOGRAPHY_A) | y.rlike(TYPOGRAPHY_B), says(True, "typography"))
        .when(_either_way(x, y, MODERNISED), says(True, "modernization"))
        .when(_either_way(x, y, EDITORIAL), says(False, "edition", "edition_variant"))
        .when(lexicon.is_us_uk(_bare(x), _bare(y)), says(True, "us_uk"))
        .when(same, says(True, "punctuation"))
        .when(unbroken, says(True, "hyphenation"))
        .otherwise(says(False, "none"))
    )


def apply_rules(cands: DataFrame, strict: bool = False) -> DataFrame:
    """without false positives, unless strict; re-categorised either way. Null texts are empty."""
    a, b = F.coalesce("pg_text", F.lit("")), F.coalesce("scan_text", F.lit(""))
    out = cands.withColumn("__v", verdict(a, b, F.col("category")))
    out = out if strict else out.filter("not __v.fp")
    return out.withColumn("category", F.coalesce("__v.new_category", "category")).drop("__v")


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The shorter and the longer of two trimmed sides; the witness's counts as shorter in a tie."""
    x, y = F.trim(a), F.trim(b)
    return F.when(F.length(y) <= F.length(x), y).otherwise(x), F.when(F.length(y) <= F.length(x), x).otherwise(y)


def is_cutoff(a: Column, b: Column) -> Column:
    """one letter cut off a word of at most four."""
    s, g = _ordered(a, b)
    return ~a.contains(" ") & ~b.contains(" ") & (F.length(g) - F.length(s) == 1) & (g.startswith(s) | g.endswith(s)) & (F.length(s) <= 3)


def is_long(a: Column, b: Column) -> Column:
    return (F.length(F.trim(a)) > 40) | (F.length(F.trim(b)) > 40)


def is_html(a: Column, b: Column) -> Column:
    return F.concat(b, a).rlike(r"<div|<span|bbox=|!\[\]\(|<img|</div")


def is_caps_header(a: Column, b: Column) -> Column:
    return T.all_caps(F.trim(b)) & (F.length(F.trim(b)) > 5)


def is_suffix(a: Column, b: Column) -> Column:
    """the shorter ends the longer, and isn't its singular."""
    s, g = _ordered(a, b)
    plural = (F.length(s) >= 4) & ((g == F.concat(s, F.lit("s"))) | (g == F.concat(s, F.lit("es"))))
    return ~s.contains(" ") & (F.length(g) - F.length(s) <= 3) & g.endswith(s) & ~plural & (F.length(s) <= 8)


def is_quoted(a: Column, b: Column, marks: str = r"^[\"“”‘«]", more: int = 20) -> Column:
    s, g = _ordered(a, b)
    return s.rlike(marks) & (F.length(g) - F.length(s) > more)


def is_footnote_variant(a: Column, b: Column) -> Column:
    ref, mark = r"\([0-9]+\)", r"[*†‡]"
    return (a.rlike(ref) & b.rlike(mark)) | (b.rlike(ref) & a.rlike(mark))


def is_punctuation_variant(a: Column, b: Column) -> Column:
    """colons, semicolons and the spaces before marks apart."""

    def core(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+([;:,.!?])", "$1"), r"[;:]", ""))

    near = (F.length(F.trim(a)) <= 60) & (F.length(F.trim(b)) <= 60)
    return near & (core(a) == core(b)) & (F.lower(F.trim(a)) != F.lower(F.trim(b)))


Filter = Callable[[Column, Column], Column]
#: In this order, the first that holds names the artefact.
FILTERS: tuple[tuple[str, Filter], ...] = (
    ("Long mismatches", is_long),
    ("HTML artifacts", is_html),
    ("ALL CAPS headers", is_caps_header),
    ("Suffix fragments", is_suffix),
    ("Quoted fragments", is_quoted),
    ("Footnote marker variants", is_footnote_variant),
    ("Punctuation variants", is_punctuation_variant),
)


def first_filter(a: Column, b: Column, filters: tuple[tuple[str, Filter], ...] = FILTERS) -> Column:
    """The name of the first filter that holds, or null."""
    return reduce(lambda c, f: c.when(f[1](a, b), f[0]), filters[1:], F.when(filters[0][1](a, b), filters[0][0]))


def mark_artifacts(cands: DataFrame) -> DataFrame:
    """without absent markers; cut-offs and filtered rows become alignment artefacts."""
    a, b = F.coalesce("pg_text", F.lit("")), F.coalesce("scan_text", F.lit(""))
    kept = cands.filter(~(a.contains("(absent in PG)") | b.contains("(absent in scan)")))
    name = F.when(is_cutoff(a, b), "Cutoff artifacts").otherwise(first_filter(a, b))
    return kept.withColumn("filter_name", name).withColumn("category", F.when(F.col("filter_name").isNotNull(), "alignment_artifact").otherwise(F.col("category")))


# --- filters of the report, which differ from those above (Q27)


def report_punctuation_only(a: Column, b: Column) -> Column:
    """F30, also where one side is empty (Q11)."""
    return (a == "") | (b == "") | (_bare(a) == _bare(b))


def report_html(a: Column, b: Column) -> Column:
    return is_html(a, b) | F.concat(b, a).rlike(r"margin-|font-|style=|class=|text-align")


def report_substring(a: Column, b: Column) -> Column:
    """F38."""
    s, g = _ordered(a, b)
    return (F.length(s) > 0) & (F.length(s) <= 10) & ~s.contains(" ") & F.lower(g).contains(F.lower(s)) & (F.length(g) - F.length(s) >= 3)


def report_unrelated(a: Column, b: Column) -> Column:
    """no word of more than three letters in common, unless both are short."""
    x, y = T.tokens(F.lower(a)), T.tokens(F.lower(b))
    shared = F.filter(F.array_intersect(x, y), lambda w: F.length(w) > 3)
    return (F.size(shared) == 0) & ~((F.size(x) <= 2) & (F.size(y) <= 2))


def looks_like_header(c: Column) -> Column:
    """short and in capitals, or two or more capitalised words."""
    t = F.trim(c)
    words = T.tokens(t)
    return (t != "") & (F.length(t) <= 40) & (T.all_caps(t) | ((F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))))


# fixed values: categories that aren't sent, and the least confidence that is
SKIPPED = ("edition_variant", "modernization", "intentional_change", "alignment_artifact", "punctuation_diff", "formatting_error", "missing_content")
LEAST_CONFIDENCE = 0.4


def submit_ready(a: Column, b: Column, category: Column, confidence: Column) -> Column:
    """what goes into the message to the editors."""
    out = _any([report_punctuation_only(a, b), is_quoted(a, b, r"^[\"'“‘]", 10), F.lower(F.concat(a, b)).contains("(absent"), is_cutoff(a, b), is_long(a, b), report_html(a, b), is_caps_header(a, b), is_suffix(a, b)])
    return ~category.isin(*SKIPPED) & (confidence >= LEAST_CONFIDENCE) & ~out & ~a.contains("FOOTNOTE") & ~b.contains("FOOTNOTE")


def is_concat_artifact(a: Column, b: Column) -> Column:
    """the base text's words, joined, are the witness's word."""
    return (F.size(T.tokens(a)) > 1) & (F.array_join(T.tokens(a), "") == F.trim(b))

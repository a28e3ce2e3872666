"""Normalisers, tokenisers and text predicates as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word character and its complement, the same in every engine that reads them.
W, NW = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_\s]"

# fixed values: phrases by which a transcription shows that it is none
REFUSALS = (
    r"^i (can't|cannot|am unable|don't|do not)",
    r"^i'm (not able|unable|sorry)",
    r"^as an ai",
    r"^i am (an?|not)",
    r"^sorry,? (i|but|but i)",
    r"^(i )?apologize",
    r"^this (image|page|scan) (is |appears )?(unclear|illegible|blurry|blank|too dark|damaged)",
    r"^(the )?(image|text|page) (is |appears )?(not|too|very)",
    r"^unable to (read|transcribe|determine|process)",
    r"^no (text|readable|visible|content)",
)
# fixed value: the least length of a usable transcription
MIN_TRANSCRIPTION = 100


def nfc(c: Column) -> Column:
    """Composed form, by an Arrow function; ASCII text is left as it is."""

    @F.pandas_udf(StringType())
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    return F.when(c.rlike(r"[^\x00-\x7F]"), compose(c)).otherwise(c)


def squeeze(c: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_for_diff(c: Column, compose: bool = False) -> Column:
    """Italics marks, footnote marks, line-end hyphens and white space; with compose also NFC."""
    c = nfc(c) if compose else c
    c = F.regexp_replace(c, r"_([^_]+)_", "$1")
    c = F.regexp_replace(c, r"\[[0-9]+\]", "FOOTNOTE")
    c = F.regexp_replace(c, r"[¹²³⁴⁵⁶⁷⁸⁹⁰]+", "FOOTNOTE")
    c = F.regexp_replace(c, rf"({W})-\s+", "$1")
    return squeeze(c)


def tokens(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def normalize_for_matching(c: Column) -> Column:
    """Lower case without tags, entities, bracketed notes and punctuation."""
    c = F.lower(c)
    for pattern, by in ((r"<[^>]+>", ""), (r"&[a-z]+;", " "), (r"&#[0-9]+;", " "), (r"\[[0-9]+\]", ""), (r"\[footnote[^\]]*\]", ""), (r"\[(?:illustration|sidenote)[^\]]*\]", ""), (r"[^\p{L}\p{N}\s]", "")):
        c = F.regexp_replace(c, pattern, by)
    return squeeze(c)


def normalize_coarse(c: Column) -> Column:
    """White space first, punctuation after, so that double spaces can stay (Q28)."""
    return F.regexp_replace(squeeze(F.lower(c)), NW, "")


def normalize_gap(c: Column) -> Column:
    """N11."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), NW, ""), r"\s+", " ")


def strip_punctuation(c: Column) -> Column:
    """N14."""
    return F.regexp_replace(c, NW, "")


def gap_words(c: Column) -> Column:
    """Lower-case words with an apostrophe inside."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+(?:'[a-z]+)?)"), F.lit(1))


def plain_words(c: Column) -> Column:
    """ASCII words with hyphens and apostrophes inside."""
    return F.regexp_extract_all(c, F.lit(r"([a-zA-Z]+(?:[-'][a-zA-Z]+)*)"), F.lit(1))


def letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^a-zA-Z]", ""))


def punctuation_only(a: Column, b: Column) -> Column:
    """The same letters, and some."""
    return (letters(a) == letters(b)) & (letters(a) != "")


def clean_segment(c: Column) -> Column:
    """Italics marks, tags, curly quotes, white space."""
    c = F.regexp_replace(F.regexp_replace(c, r"_([^_]+)_", "$1"), r"<[^>]+>", "")
    return squeeze(F.translate(c, "“”‘’", "\"\"''"))


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, rf"({W})-\s+", "$1")


def normalize_possessive(c: Column) -> Column:
    """N22, with its quirk for a final double s (Q25)."""
    return F.trim(F.regexp_replace(c, r"[‘’'s]s$", ""))


def best_text(vision: Column, ocr: Column) -> Column:
    """The vision text where there is one."""
    return F.coalesce(F.nullif(vision, F.lit("")), F.nullif(ocr, F.lit("")), F.lit(""))


def sentences(c: Column, least: int = 20) -> Column:
    """Sentence chunks; lines where there is at most one."""
    def long(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= least)

    by_mark, by_line = long(F.split(c, r"[.!?;]\s+")), long(F.split(c, "\n"))
    return F.when((F.size(by_mark) <= 1) & (F.size(by_line) > 1), by_line).otherwise(by_mark)


def all_caps(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def _alphabetic(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def strip_paratext(c: Column) -> Column:
    """Without page numbers, running heads, ornaments and picture marks; at most two blank lines."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))

    def kept(x: Column) -> Column:
        head = all_caps(x) & (F.length(x) < 80) & (_alphabetic(x) > F.length(x) * 0.4) & ~x.rlike(r"[.\"!?]$")
        drop = x.rlike(r"^[0-9]+$") | x.rlike(r"^Page\s+[0-9]+$") | (x.rlike(r"^[0-9]+\s+[A-Z]") & (F.length(x) < 60)) | head | (_alphabetic(x) < 5) | x.rlike(r"^\[.*[Ii]llustration")
        return (x == "") | ~drop

    return F.trim(F.regexp_replace(F.array_join(F.filter(lines, kept), "\n"), r"\n{4,}", "\n\n\n"), F.lit(" \n"))


def strip_page_header(c: Column) -> Column:
    """F19 without given headers: a short first line that ends no sentence goes."""
    first = F.trim(F.get(F.split(c, "\n"), F.lit(0)))
    rest = F.trim(F.array_join(F.slice(F.split(c, "\n"), 2, F.size(F.split(c, "\n"))), "\n"), F.lit(" \n\t\r"))
    return F.when((F.length(first) < 40) & ~first.rlike(r"[.!?]$"), rest).otherwise(c)


def is_non_content(c: Column) -> Column:
    """too short, a table of contents, or a model's remark."""
    t = F.trim(c, F.lit(" \n\t\r"))
    dotted = F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"(\.\s*){4,}")))
    return (F.size(tokens(t)) < 10) | t.rlike(r"(?i)^\s*contents\s*[\n\r]") | (dotted >= 2) | t.rlike(r"(\.\s*){8,}") | F.lower(t).contains("color calibration") | F.lower(t).contains("does not contain any text")


def transcription_fault(raw: Column, cleaned: Column) -> Column:
    """why a transcription is unusable, or ''."""
    line = F.lower(F.trim(F.get(F.split(F.trim(raw, F.lit(" \n\t\r")), "\n"), F.lit(0))))
    return (
        F.when(F.trim(F.coalesce(raw, F.lit("")), F.lit(" \n\t\r")) == "", "empty")
        .when(line.rlike("|".join(f"(?:{p})" for p in REFUSALS)), "refusal")
        .when(F.length(cleaned) < MIN_TRANSCRIPTION, "short")
        .otherwise("")
    )


def slug(c: Column, most: int = 60) -> Column:
    """Lower-case words joined by hyphens, cut at a word within `most` characters."""
    full = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(F.length(full) <= most, full).otherwise(F.regexp_replace(F.substring(full, 1, most), r"-[^-]*$", ""))


def year(c: Column) -> Column:
    """N41."""
    return F.nullif(F.regexp_extract(c, r"([0-9]{4})", 1), F.lit("")).cast("int")


def normalize_publisher(c: Column) -> Column:
    """N40."""
    c = F.trim(F.lower(c))
    for prefix in ("the ", "and ", "& "):
        c = F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 20)).otherwise(c)
    return squeeze(F.regexp_replace(c, r"[.,]+$", ""))


def title_words(c: Column) -> Column:
    head = F.trim(F.lower(F.get(F.split(c, r"(?i)[:;]\s*|--|,\s+(?:a |an |the )"), F.lit(0))))
    for prefix in ("the ", "a ", "an "):
        head = F.when(head.startswith(prefix), F.substring(head, len(prefix) + 1, 1 << 20)).otherwise(head)
    return F.array_distinct(tokens(head))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the titles' words without subtitles and articles."""
    x, y = title_words(a), title_words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def jaccard(a: Column, b: Column) -> Column:
    """X5 of two arrays without repeats; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# fixed values: the words that make a text English, and how much of it is looked at for them
ENGLISH, LOOKED_AT = ("the", "and", "of", "to", "a", "in", "is", "it", "that", "was"), 5000


def language_guess(text: Column, looked_at: int | None = LOOKED_AT) -> Column:
    """scripts and umlauts over the whole text, English words by the rule in its first 5000 characters, with None in all of it."""
    head = text if looked_at is None else F.substring(text, 1, looked_at)
    english = F.size(F.filter(F.split(F.lower(head), r"\s+"), lambda x: F.regexp_replace(x, r"[.,;:!?\"']+$", "").isin(*ENGLISH)))
    return (
        F.when(F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")) > 50, "cjk")
        .when(F.regexp_count(text, F.lit(r"[\x{0400}-\x{04ff}]")) > 50, "cyrillic")
        .when(F.regexp_count(F.lower(text), F.lit("[äöüß]")) > 20, "german")
        .when(english > 20, "english")
        .otherwise("unknown")
    )

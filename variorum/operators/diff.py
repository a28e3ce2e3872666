"""Word differences of aligned passages: kernels as Arrow functions, classification as columns."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import runs
from variorum.functions import text as T
from variorum.runtime import dealt

ABSENT_A, ABSENT_B = "(absent in PG)", "(absent in scan)"
#: fixed values: least anchors and gaps of the recursive and the stitched diff
ANCHOR, ANCHORS, SMALL_GAP, DRIFT_RATIO, DRIFT_WORDS = 5, 3, 3, 0.3, 8

HUNKS = "array<struct<seq:int,tag:string,a_text:string,b_text:string,i1:int,j1:int>>"
_HUNK = pa.list_(pa.struct([("seq", pa.int32()), ("tag", pa.string()), ("a_text", pa.string()), ("b_text", pa.string()), ("i1", pa.int32()), ("j1", pa.int32())]))


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """A1: Ratcliff-Obershelp over words, no word counted as junk."""
    return runs.opcodes(a, b)


def anchors(a: list[str], b: list[str], least: int = ANCHOR) -> list[tuple[int, int, int]]:
    return [m for m in runs.blocks(a, b) if m[2] >= least]


def flat_hunks(a: list[str], b: list[str], i0: int = 0, j0: int = 0) -> list[tuple[str, str, str, int, int]]:
    return [(tag, " ".join(a[i1:i2]), " ".join(b[j1:j2]), i0 + i1, j0 + j1) for tag, i1, i2, j1, j2 in opcodes(a, b) if tag != "equal"]


def gap_hunks(a: list[str], b: list[str], i0: int, j0: int) -> list[tuple[str, str, str, int, int]]:
    """Of a gap between anchors; large one-sided gaps and unlike passages are drift and give nothing."""
    if not a:
        return [("extra", "", w, i0, j0 + k) for k, w in enumerate(b)] if len(b) <= SMALL_GAP else []
    if not b:
        return [("missing", w, "", i0 + k, j0) for k, w in enumerate(a)] if len(a) <= SMALL_GAP else []
    if max(len(a), len(b)) > DRIFT_WORDS and runs.ratio(a, b) < DRIFT_RATIO:
        return []
    return flat_hunks(a, b, i0, j0)


def anchored_hunks(a: list[str], b: list[str], least_words: int = 20, least_anchors: int = ANCHORS) -> list[tuple[str, str, str, int, int]]:
    """The gaps between anchors, each by itself; the flat diff where there are too few anchors."""
    if min(len(a), len(b)) < least_words:
        return flat_hunks(a, b)
    found = anchors(a, b)
    if sum(size > 0 for _, _, size in found) < least_anchors:
        return flat_hunks(a, b)
    out, i, j = [], 0, 0
    for at, bt, size in [*found, (len(a), len(b), 0)]:
        out += gap_hunks(a[i:at], b[j:bt], i, j)
        i, j = at + size, bt + size
    return out


MODES = {"flat": flat_hunks, "recursive": anchored_hunks, "stitched": lambda a, b: anchored_hunks(a, b, 1, 2)}


def _differ(mode: str):
    find = MODES[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column("a_norm").to_pylist(), batch.column("b_norm").to_pylist(), strict=True):
                found = find((a or "").split(" ") if a else [], (b or "").split(" ") if b else [])
                rows.append([{"seq": k, "tag": x[0], "a_text": x[1], "b_text": x[2], "i1": x[3], "j1": x[4]} for k, x in enumerate(found)])
            keep = [c for c in batch.schema.names if c not in ("a_norm", "b_norm")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, _HUNK)], names=[*keep, "hunks"])

    return run


def hunks(pairs: DataFrame, keys: list[str], a: str = "a_text", b: str = "b_text", mode: str = "flat", parts: int | None = None) -> DataFrame:
    """(keys, seq, tag, a_text, b_text, i1, j1): the word differences of each pair.

    A pair is one task's work and pairs are dealt out evenly, so that costly ones
    don't meet; null texts are empty. parts sets the number of partitions.
    """
    ready = pairs.select(*keys, T.normalize_for_diff(F.coalesce(F.col(a), F.lit("")), True).alias("a_norm"), T.normalize_for_diff(F.coalesce(F.col(b), F.lit("")), True).alias("b_norm"))
    ready = ready.repartition(parts, *keys) if parts else dealt(ready, *keys)
    schema = ", ".join(f"`{c}` {t}" for c, t in ready.dtypes if c in keys)
    found = ready.mapInArrow(_differ(mode), f"{schema}, hunks {HUNKS}")
    return found.select(*keys, F.explode("hunks").alias("h")).select(*keys, "h.*")


def category(a: Column, b: Column) -> Column:
    """Of a replacement."""
    x, y = F.lower(a), F.lower(b)
    return (
        F.when(x == y, "formatting_error")
        .when(T.punctuation_only(a, b), "punctuation_diff")
        .when((F.length(a) > 2) & (F.length(b) > 2) & (F.levenshtein(x, y, 1) == 1), "ocr_scanno")
        .otherwise("wrong_word")
    )


def same_content(a: Column, b: Column) -> Column:
    """The cases in which a hunk is no difference: markup, case, footnote style, line-end hyphens."""
    ca, cb = T.clean_segment(a), T.clean_segment(b)
    notes = F.regexp_replace(a, r"\[[0-9]+\]", "FOOTNOTE") == F.regexp_replace(b, r"[¹²³⁴⁵⁶⁷⁸⁹⁰]+", "FOOTNOTE")
    return (F.lower(ca) == F.lower(cb)) | notes | (T.dehyphenate(a) == T.dehyphenate(b))


def _fragment(c: Column) -> Column:
    t = F.trim(c)
    least = F.when(F.substring(t, -1, 1).isin(list(".,;:!?)\"'")), 4).otherwise(5)
    return (t == "") | (~t.contains(" ") & (F.length(t) < least))


def is_fragment(a: Column, b: Column) -> Column:
    """a word cut off at the edge of an alignment."""
    return ~((F.length(a) >= 10) & (F.length(b) >= 10)) & (_fragment(a) | _fragment(b))


def has_page_reference(a: Column, b: Column) -> Column:
    """F3."""
    return a.rlike(r"\{[0-9]+[a-z]*\}") | b.rlike(r"\{[0-9]+[a-z]*\}")


def candidates(found: DataFrame) -> DataFrame:
    """The hunks that are differences, with category and description; fragments and page references go.

    One-sided words of small gaps, tagged extra and missing, bypass these tests.
    """
    a, b = F.col("a_text"), F.col("b_text")
    gap = F.col("tag").isin("extra", "missing")
    kept = found.filter(gap | ~same_content(a, b))
    pg = F.when(F.col("tag") == "insert", ABSENT_A).otherwise(a)
    scan = F.when(F.col("tag") == "delete", ABSENT_B).otherwise(b)
    kind = F.when(F.col("tag") == "replace", category(a, b)).when(F.col("tag").isin("delete", "extra"), "extra_word").otherwise("missing_word")
    says = (
        F.when(F.col("tag") == "replace", F.concat(F.lit("PG has '"), a, F.lit("' where scan has '"), b, F.lit("'")))
        .when(F.col("tag") == "delete", F.concat(F.lit("PG has extra text: '"), a, F.lit("'")))
        .when(F.col("tag") == "insert", F.concat(F.lit("PG is missing text: '"), b, F.lit("'")))
        .when(F.col("tag") == "extra", F.concat(F.lit("Extra word in scan: '"), b, F.lit("'")))
        .otherwise(F.concat(F.lit("Missing from scan: '"), a, F.lit("'")))
    )
    out = kept.withColumns({"pg_text": pg, "scan_text": scan, "category": kind, "diff_description": says})
    out = out.filter(F.col("tag").isin("extra", "missing") | ~(is_fragment(F.col("pg_text"), F.col("scan_text")) | has_page_reference(F.col("pg_text"), F.col("scan_text"))))
    return out.drop("a_text", "b_text")


def ratio(a: list, b: list, autojunk: bool = True) -> float:
    """The similarity of two sequences, junk as the site of use counts it."""
    return SequenceMatcher(None, a, b, autojunk=autojunk).ratio() if a and b else 0.0

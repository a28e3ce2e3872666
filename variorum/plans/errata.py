"""The errata plan: pages against their book's text, from alignment to scored errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators import align, diff, gaps, pages, report, rules, score, stitched
from variorum.runtime import dealt


@dataclass
class Errata:
    alignments: DataFrame
    candidates: DataFrame
    errors: DataFrame
    gaps: DataFrame
    replacements: DataFrame
    summary: DataFrame


def passages(alignments: DataFrame, books: DataFrame, own: DataFrame) -> DataFrame:
    """(book_id, scan_page, pg_start, confidence, passage, page_text); the surest alignment of a page counts."""
    best = alignments.groupBy("book_id", "scan_page").agg(F.max_by(F.struct("pg_start", "pg_end", "confidence"), F.struct("confidence", -F.col("pg_start"))).alias("a")).select("book_id", "scan_page", "a.*")
    text = own.select("book_id", F.col("page_num").alias("scan_page"), F.col("text").alias("page_text"))
    met = best.join(text, ["book_id", "scan_page"]).join(books, "book_id")
    passage = F.substring("body_text", (F.col("pg_start") + 1).cast("int"), (F.col("pg_end") - F.col("pg_start")).cast("int"))
    return met.select("book_id", "scan_page", "pg_start", "confidence", passage.alias("passage"), "page_text")


def run(books: DataFrame, own: DataFrame, mode: str = "recursive", strict: bool = False) -> Errata:
    """books has (book_id, body_text), own has pages (book_id, page_num, text).

    mode is flat, recursive (page by page) or stitched (neighbouring pages as one text).

    Offsets: pg_offset_ref adds a word's number to the passage's start, as older
    reports do (Q1); pg_offset is the character where the word stands in the
    normalised passage. Pages without an alignment are left to the gaps.
    """
    cleaned = own.withColumn("text", T.strip_paratext(F.coalesce("text", F.lit(""))))
    aligned = align.global_align(cleaned, books.withColumnRenamed("body_text", "book_text"), "book_id", "page_num").select("book_id", "scan_page", "pg_start", "pg_end", "confidence")
    pairs = passages(aligned, books, cleaned)
    if mode == "stitched":
        best = pairs.select("book_id", "scan_page", "pg_start", (F.col("pg_start") + F.length("passage")).alias("pg_end"))
        texts = stitched.segments(books, best, cleaned).select("book_id", "segment_id", "a_norm")
        found = stitched.candidates(books, best, cleaned)
        sure = pairs.select("book_id", "scan_page", "confidence", T.normalize_for_diff(F.col("passage")).alias("page_norm"))
        told = found.join(sure, ["book_id", "scan_page"]).join(texts, ["book_id", "segment_id"], "left").withColumn("norm", F.when(F.col("whole"), F.col("a_norm")).otherwise(F.col("page_norm")))
        order = Window.partitionBy("book_id", "scan_page").orderBy("segment_id", "seq")
        told = told.withColumn("seq", F.row_number().over(order) - 1).drop("a_norm", "page_norm", "whole", "segment_id", "pg_offset_ref")
    else:
        found = diff.candidates(diff.hunks(pairs, ["book_id", "scan_page"], "passage", "page_text", mode))
        # the rules and scores that follow take long over few bytes
        keys = ("book_id", "scan_page")
        told = dealt(found, *keys).join(dealt(pairs, *keys), list(keys)).withColumn("norm", T.normalize_for_diff(F.col("passage")))
    before = F.length(F.array_join(F.slice(F.split("norm", " "), F.lit(1), F.col("i1")), " ")) + F.when(F.col("i1") > 0, 1).otherwise(0)
    told = told.withColumns({"in_passage": before, "pg_offset_ref": F.col("pg_start") + F.col("i1"), "pg_offset": F.col("pg_start") + before})
    kept = rules.mark_artifacts(rules.apply_rules(told, strict))
    scored = score.with_score(kept, "norm", "in_passage", "confidence", score.edit_score_any(F.col("pg_text"), F.col("scan_text"))).withColumn("verdict", score.verdict(F.col("score")))
    errors = scored.select("book_id", "scan_page", "seq", "pg_text", "scan_text", "category", "diff_description", "pg_offset", "pg_offset_ref", F.col("score").alias("confidence"), "verdict", "filter_name")
    words = books.select(F.explode(F.split("body_text", r"[^\p{L}\p{N}_]+")).alias("word")).filter("word <> ''")
    missing = gaps.all_gaps(pages.page_map(cleaned, "book_id", "page_num"), aligned, books.withColumnRenamed("body_text", "book_text"), "book_id", "page_num")
    replaced = score.global_replacements(errors, words, "scan_page")
    replaced = replaced.unionByName(score.promoted(errors, books, replaced))
    return Errata(aligned, found, errors, missing, replaced, report.summary(errors))

"""Edition comparison: the pages of one edition laid on the text of another, and their variants."""

from __future__ import annotations

from pyspark.sql import DataFrame

from variorum.operators import align, diff, variants
from variorum.plans.errata import passages


def run(books_a: DataFrame, pages_b: DataFrame, mode: str = "flat") -> DataFrame:
    """(book_id, b_page, seq, pg_text, scan_text, variant, significance, confidence).

    books_a has (book_id, body_text), pages_b has (book_id, page_num, text). The
    page is that of edition B (Q16).
    """
    aligned = align.global_align(pages_b, books_a.withColumnRenamed("body_text", "book_text"), "book_id", "page_num").select("book_id", "scan_page", "pg_start", "pg_end", "confidence")
    pairs = passages(aligned, books_a, pages_b)
    found = diff.candidates(diff.hunks(pairs, ["book_id", "scan_page"], "passage", "page_text", mode))
    told = variants.classify(found).join(pairs.select("book_id", "scan_page", "confidence"), ["book_id", "scan_page"])
    return told.select("book_id", told["scan_page"].alias("b_page"), "seq", "pg_text", "scan_text", "variant", "significance", "confidence")

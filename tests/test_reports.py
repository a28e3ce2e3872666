import gzip
import re

from pyspark.sql import functions as F

from variorum import queries
from variorum.operators import markdown, score
from variorum.sources import ocr

DATA = "/root/testdata/sf0.001"


def test_audit_report_has_a_block_for_each_error(spark):
    errors, books = queries.queries_pages._judged(spark, DATA)
    rows = errors.collect()
    for r in queries.QUERIES["audit_report"](spark, DATA).collect():
        own = [e for e in rows if e.book_id == r.book_id]
        kept = [e for e in own if e.category != "alignment_artifact"]
        sure = [e for e in kept if e.verdict == "scan_correct" and e.confidence >= 0.8 and e.category != "edition_variant"]
        assert f"| **Total candidates** | {len(kept)} |" in r.text and r.text.startswith(f"# Quality Audit Report: Book {r.book_id}\n")
        assert len(re.findall(r"(?m)^### Error \d+ - ", r.text)) == len(sure)
        medium = r.text.partition("## Medium Confidence Errors")[2].partition("## Low")[0]
        assert len(re.findall(r"(?m)^\d+\. \*\*Page ", medium)) == sum(0.5 <= e.confidence < 0.8 for e in kept)
        assert "(confidence: 70%)" in medium or not any(e.confidence == 0.7 for e in kept)


def test_gap_lines(spark):
    own = spark.createDataFrame([(1, k, t) for k, t in enumerate(["MY BOOK 1\nalpha text", "2\nMY BOOK\nbeta one two three", "MY BOOK\ngamma four\n\nfive", "MY BOOK\ndelta end"])], "book_id long, page_num long, text string")
    gaps = spark.createDataFrame([(1, 1, "uncovered", 4, "beta", 0.0, True, 0.0, "high", ""), (1, 2, "uncovered", 3, "gamma", 0.0, True, 0.0, "low", ""), (1, 3, "content_hole", 2, "x", 0.0, True, 0.0, "medium", "lost\nwords 12")], "book_id long, page long, strategy string, word_count long, preview string, coverage_ratio double, pg_verified boolean, pg_match_ratio double, confidence string, missing_words string")
    al = spark.createDataFrame([(1, 0, 0, 10), (1, 3, 22, 40)], "book_id long, scan_page long, pg_start long, pg_end long")
    books = spark.createDataFrame([(1, "alpha text of_ the rest delta end of it")], "book_id long, body_text string")
    got = [r.text for r in markdown.gap_lines(gaps, own, al, books).orderBy("section", "n").collect()]
    assert got[0] == 'Page 3 - 2 words [MEDIUM]:\nMissing: "lost\nwords 12"\n'
    assert got[1] == "Pages 1-2 - ~7 words [HIGH]:\nbeta one two three\n\ngamma four\n\nfive\n\nPG context: ...alpha [gap] delta end of it...\n"
    assert [tuple(r) for r in markdown.gap_counts(gaps).collect()] == [(1, 3, 1, 1, 2, 0, 1, 1, 1)]
    assert markdown.gap_lines(gaps.filter("false"), own, al, books).count() == 0


def test_replacements_are_listed_once(spark):
    found = spark.createDataFrame([("Word.", "Wörd", 3, 4), ("word", "wörd", 1, 9), ("b'", "c", 1, 1)], "pg_root string, scan_root string, caught long, occurrences long")
    assert [(r.text, r.caught, r.occurrences) for r in markdown.replacement_lines(found).collect()] == [("b ==> c", 1, 1), ("Word ==> Wörd", 3, 9)]


def test_comparison_says_how_many_are_left_out(spark):
    rows = [(1, p, s, "textual_variant", "moderate" if s < 60 else "major", 0.875, f"a{s}", "b") for p in (1,) for s in range(63)]
    df = spark.createDataFrame(rows, "book_id long, b_page long, seq long, variant string, significance string, confidence double, pg_text string, scan_text string")
    text = markdown.document(markdown.comparison_report(df)).first().text
    assert "**63 total variants** found" in text and text.count("**A:**") == 3 and "\n... and 10 more" in text and '**50.** Page 1: "a49" → "b"' in text and "a50" not in text and "(confidence: 88%)" in text


def test_ocr_text_of_files(spark):
    page = "<document xmlns='http://x.example/s'><page><line><charParams>H</charParams><charParams>i</charParams></line><line> </line><line><charParams>you</charParams></line></page></document>"
    rows = [(1, "a_abbyy.gz", gzip.compress(page.encode())), (1, "a_djvu.txt", b"other"), (2, "b_djvu.txt", "só\n".encode()), (3, "c_abbyy.xml", b"<broken"), (4, "d.pdf", b"x"), (5, "e_abbyy.xml", b"<d><line>plain <b>line</b></line></d>"), (6, "f_abbyy.gz", None), (6, "f_djvu.txt", b"there")]
    got = {r.book_id: r.ocr_text for r in ocr.ocr_text(spark.createDataFrame(rows, "book_id long, name string, content binary")).collect()}
    assert got == {1: "Hi\nyou", 2: "só\n", 5: "plain line", 6: "there"}


def test_page_statistics_by_counts(spark):
    pages = [k for k in range(9) for _ in range(k % 4 + 1)]
    df = spark.createDataFrame([(p,) for p in pages], "item_id long")
    counts = sorted(pages.count(p) for p in set(pages))
    r = score.page_stats(df).first()
    assert (r.total, r.pages, r.average, r["median"], r.most) == (len(pages), 9, len(pages) / 9, counts[len(counts) // 2], 4)
    assert score.page_stats(df.filter("false")).first().total is None and F is not None

"""Reports: ordered lines of text and JSON rows of differences, variants and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.operators import rules


def arrow_fix(a: Column, b: Column, line: Column, note: Column | None = None) -> Column:
    """`line 12: this ==> that [note]`."""
    said = F.concat(F.lit("line "), line.cast("string"), F.lit(": "), a, F.lit(" ==> "), b)
    return said if note is None else F.concat(said, F.lit(" ["), note, F.lit("]"))


def derived_category(category: Column, verdict: Column) -> Column:
    """an artefact stays one; a verdict for the base text or the edition wins over the candidate's category."""
    return (
        F.when(category == "alignment_artifact", category)
        .when(verdict == "edition_variant", "edition_variant")
        .when(verdict == "intentional_modernization", "modernization")
        .when(verdict == "pg_correct", "intentional_change")
        .when(verdict.isin("scan_correct", "unable_to_verify", "ambiguous"), category)
        .otherwise("ambiguous")
    )


def severity(category: Column) -> Column:
    """F52."""
    return (
        F.when(category == "missing_content", "critical")
        .when(category.isin("ocr_scanno", "wrong_word", "missing_word"), "high")
        .when(category.isin("extra_word", "missing_punctuation", "encoding_error", "punctuation_diff"), "medium")
        .when(category == "formatting_error", "low")
        .otherwise("info")
    )


def sentence_at(text: Column, offset: Column, length: Column) -> Column:
    """The sentence around a place, on one line and without italics marks; '' outside the text."""
    head, rest = F.substring(text, F.lit(1), offset), F.substring(text, offset + 1, F.length(text))
    before = F.regexp_extract(head, r"[^.!?]*$", 0)
    here, after = F.substring(rest, F.lit(1), length), F.substring(rest, length + 1, F.length(text))
    end = F.regexp_extract(after, r"^(?:[^.!?\n]|\n(?!\n))*[.!?]?", 0)
    said = F.replace(F.trim(F.regexp_replace(F.concat(before, here, end), r"\s+", " ")), F.lit("_"), F.lit(""))
    return F.when((offset < 0) | (offset >= F.length(text)), "").otherwise(said)


def page_url(scan: Column, page: Column) -> Column:
    """S72."""
    return F.concat(F.lit("https://archive.org/details/"), scan, F.lit("/page/n"), page.cast("string"), F.lit("/mode/1up"))


def errata_lines(errors: DataFrame, line: str = "pg_file_line") -> DataFrame:
    """(book_id, pg_file_line, seq, text): what goes to the editors, in order of the file.

    errors has book_id, seq, pg_text, scan_text, category, confidence and the line.
    """
    a, b = F.col("pg_text"), F.col("scan_text")
    ready = errors.filter(rules.submit_ready(a, b, F.col("category"), F.col("confidence")) & ~rules.is_concat_artifact(a, b))
    return ready.select("book_id", F.col(line).alias("pg_file_line"), "seq", arrow_fix(a, b, F.col(line)).alias("text")).orderBy("book_id", "pg_file_line", "seq")


def error_json(errors: DataFrame) -> DataFrame:
    """A JSON object a row, without alignment artefacts."""
    own = errors.filter("category <> 'alignment_artifact'")
    return own.select("book_id", F.to_json(F.struct(*[c for c in own.columns if c != "book_id"])).alias("json"))


def summary(errors: DataFrame) -> DataFrame:
    """G1, G6, G7 per book."""
    c = F.col("confidence")
    kept = F.col("category") != "alignment_artifact"
    return errors.groupBy("book_id").agg(
        F.count_if(kept).alias("total_candidates"),
        F.count_if(kept & (c >= 0.8)).alias("high_confidence"),
        F.count_if(kept & (c >= 0.5) & (c < 0.8)).alias("medium_confidence"),
        F.count_if(kept & (c < 0.5)).alias("low_confidence"),
        F.countDistinct("scan_page").alias("pages_checked"),
    )


def comparison_lines(chapters: DataFrame, chapter: str = "chapter") -> DataFrame:
    """A table row in Markdown for each chapter of a variants' rollup."""
    cells = [F.col(c).cast("string") for c in (chapter, "first_page", "last_page", "n", "major", "moderate", "minor", "trivial")]
    return chapters.orderBy("first_seq").select(chapter, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"))


def save(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON, Parquet or text in a folder; the write is atomic by the commit protocol."""
    if kind == "text":
        df.select("text").write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def exit_code(high: int, total: int) -> int:
    """C6."""
    return 2 if high else 1 if total else 0

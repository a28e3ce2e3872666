"""Pages of a book: stitching, page maps, segments, headers, chapters, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T


def page_map(pages: DataFrame, book: str = "conv_id", page: str = "turn", text: str = "text") -> DataFrame:
    """(book, page, start_offset, end_offset, page_text) of non-empty pages joined by one space."""
    own = pages.select(book, page, F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \n\t\r")).alias("page_text")).filter("page_text <> ''")
    before = Window.partitionBy(book).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("page_text") + 1).over(before), F.lit(0)).cast("long")
    return own.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.length("page_text"))


def stitched(pages: DataFrame, book: str = "conv_id", page: str = "turn", text: str = "text") -> DataFrame:
    """One text a book. A book is a row of the result."""
    own = page_map(pages, book, page, text)
    ordered = F.array_sort(F.collect_list(F.struct(page, "page_text")))
    return own.groupBy(book).agg(F.array_join(F.transform(ordered, lambda x: x["page_text"]), " ").alias("book_text"))


def token_pages(pages: DataFrame, book: str = "conv_id", page: str = "turn", text: str = "text") -> DataFrame:
    """(book, token_no, token, page) of the stitched text; a page counts its own tokens, pages are summed up."""
    own = page_map(pages, book, page, text).withColumn("w", T.tokens(F.col("page_text")))
    before = Window.partitionBy(book).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("base", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0)))
    return own.select(book, page, "base", F.posexplode("w").alias("i", "token")).select(book, (F.col("base") + F.col("i")).cast("long").alias("token_no"), "token", F.col(page).alias("page_num"))


def segments(alignments: DataFrame, book: str = "conv_id", page: str = "scan_page") -> DataFrame:
    """Alignments with the number of their segment: consecutive pages with nearly consecutive text."""
    w = Window.partitionBy(book).orderBy(page)
    gap, jump = F.col(page) - F.lag(page).over(w), F.col("pg_start") - F.lag("pg_end").over(w)
    new = F.when((gap <= 1) & (jump > -50) & (jump < 500), 0).otherwise(1)
    return alignments.withColumn("__new", new).withColumn("segment_id", F.sum("__new").over(w).cast("long")).drop("__new")


def islands(rows: DataFrame, book: str, page: str) -> DataFrame:
    """Rows with the first page of their run of consecutive pages."""
    w = Window.partitionBy(book).orderBy(page)
    keyed = rows.withColumn("__run", F.col(page) - F.row_number().over(w))
    return keyed.withColumn("run_start", F.min(page).over(Window.partitionBy(book, "__run"))).drop("__run")


def neighbours(rows: DataFrame, book: str, page: str) -> DataFrame:
    """Rows with the nearest aligned text before and after; pg_start and pg_end are null where unaligned."""
    w = Window.partitionBy(book).orderBy(page)
    before = F.last("pg_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("pg_start", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"prev_end": before, "next_start": after})


def overlapping(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], width: int = 4096) -> DataFrame:
    """Pairs of rows of one key whose spans [start, end) overlap, by an equi-join on bins of `width` characters.

    A pair counts in the bin where its overlap begins, so that it is a row once.
    """

    def binned(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        low, high = F.floor(F.col(span[0]) / width), F.floor((F.col(span[1]) - 1) / width)
        return df.filter(F.col(span[0]) < F.col(span[1])).withColumn("__bin", F.explode(F.sequence(low, high)))

    met = binned(a, a_span).join(binned(b, b_span), [key, "__bin"])
    starts = F.greatest(F.col(a_span[0]), F.col(b_span[0]))
    both = (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1]))
    return met.filter(both & (F.floor(starts / width) == F.col("__bin"))).drop("__bin")


def running_headers(pages: DataFrame, book: str = "conv_id", page: str = "turn", text: str = "text") -> DataFrame:
    """Short lines that stand on two pages or more of a book."""
    lines = pages.select(book, page, F.explode(F.split(text, "\n")).alias("line")).select(book, page, F.trim("line").alias("line")).filter("line <> '' and length(line) <= 40")
    return lines.groupBy(book, "line").agg(F.countDistinct(page).alias("n_pages")).filter("n_pages >= 2")


def lines_with_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, start): lines and where they start, within the row's own array."""
    own = docs.select(key, F.split(F.col(text), "\n").alias("ls"))
    rows = own.select(key, F.posexplode("ls").alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))


def chapters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, title, start, end): headings are chapter lines and lines of capitals; a chapter ends at the next."""
    lines = lines_with_offsets(docs, key, text)
    t = F.trim("line")
    head = t.rlike(r"^(?i:chapter)\s+([IVXLCDM]+|[0-9]+)\b") | (T.all_caps(t) & (F.length(t) >= 5) & (F.length(t) <= 60))
    own = lines.filter(head).select(key, t.alias("title"), "start")
    size = docs.select(key, F.length(text).cast("long").alias("size"))
    return own.join(size, key).withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("start")), F.col("size"))).drop("size")


def chapter_of(offsets: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Offsets with their chapter's title, null before the first; joined by the key, then by the interval."""
    inside = offsets.join(found.select(key, "title", "start", "end"), key).filter("offset >= start and offset < end").select(key, "offset", "title")
    return offsets.join(inside, [key, "offset"], "left")


def nearest_occurrence(text: Column, word: Column, offset: Column) -> Column:
    """0-based place of the occurrence of word nearest to offset, the earlier of two; null for none."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")), -1)
    sizes = F.transform(parts, lambda x: F.length(x).cast("long"))
    step = F.length(word).cast("long")
    places = F.aggregate(
        F.slice(sizes, F.lit(1), F.size(sizes) - 1),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("best")),
        lambda s, x: F.struct((s["at"] + x + step).alias("at"), F.when(s["best"].isNull() | (F.abs(s["at"] + x - offset) < F.abs(s["best"] - offset)), s["at"] + x).otherwise(s["best"]).alias("best")),
    )
    return places["best"]

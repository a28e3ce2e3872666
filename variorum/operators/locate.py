"""Where a difference stands in its book's file: line numbers, surrounding lines."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: how many lines a passage may span, the most words looked for word by word, and the share that must be alike
SPAN_LINES, FUZZY_WORDS, FUZZY_SHARE = 6, 5, 0.8


def clean_search(text: Column) -> Column:
    """A passage as it is looked for in a file: single spaces, straight quotes, hyphens for dashes."""
    return F.trim(F.translate(F.regexp_replace(text, r"\s+", " "), "“”‘’—–", "\"\"''--"))


def clean_line(line: Column) -> Column:
    """A line of an HTML file without tags, with its common references resolved and single spaces."""
    line = F.regexp_replace(line, "<[^>]+>", " ")
    for name, sign in (("ldquo", '"'), ("rdquo", '"'), ("lsquo", "'"), ("rsquo", "'"), ("mdash", "-"), ("ndash", "-"), ("amp", "&")):
        line = F.replace(line, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def file_lines(text: Column) -> Column:
    """The cleaned lines of a file."""
    return F.transform(F.split(text, r"\r\n|\n|\r"), clean_line)


class Lines:
    """The lines of a file, joined once, so that a look-up is a search in one string."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.joined = "\n".join(lines)
        self.starts = self._starts(lines)
        self.full = [n for n, x in enumerate(lines, 1) if x]
        texts = [x for x in lines if x]
        self.flowing, self.flow_starts = " ".join(texts), self._starts(texts)
        self.words: list[list[str]] | None = None

    @staticmethod
    def _starts(lines: list[str]) -> list[int]:
        at, out = 0, []
        for x in lines:
            out.append(at)
            at += len(x) + 1
        return out

    def find(self, passage: str) -> int:
        """The first line that holds the passage, else the first of the fewest lines over which it runs, else a line of like words; 0 for none."""
        at = self.joined.find(passage)
        if at >= 0:
            return bisect_right(self.starts, at)
        span, first = SPAN_LINES + 1, 0
        at = self.flowing.find(passage)
        while at >= 0:
            a, b = (self.full[bisect_right(self.flow_starts, x) - 1] for x in (at, at + len(passage) - 1))
            if b - a + 1 < span:
                span, first = b - a + 1, a
            at = self.flowing.find(passage, at + 1)
        return first or self.alike(passage)

    def alike(self, passage: str) -> int:
        """The first line with a run of as many words, four fifths of which hold or are held by the passage's."""
        wanted = passage.lower().split()
        if not 0 < len(wanted) <= FUZZY_WORDS:
            return 0
        if self.words is None:
            self.words = [x.lower().split() for x in self.lines]
        for number, words in enumerate(self.words, 1):
            for i in range(len(words) - len(wanted) + 1):
                same = sum(a in b or b in a for a, b in zip(wanted, words[i:], strict=False))
                if same >= len(wanted) * FUZZY_SHARE:
                    return number
        return 0


def _finder(key: tuple, asked: pa.Table, files: pa.Table) -> pa.Table:
    lines = Lines(files.column("lines")[0].as_py() if files.num_rows else [])
    found = [lines.find(x) if x is not None else 0 for x in asked.column("passage").to_pylist()]
    return pa.table({"book": asked.column("book"), "row": asked.column("row"), "line": pa.array(found, pa.int64())})


def with_lines(errors: DataFrame, files: DataFrame, book: str = "book_id", passage: str = "pg_text", text: str = "html") -> DataFrame:
    """Errors with pg_file_line, the 1-based line of their book's file that holds the passage, 0 for none.

    files has a row for each book, (book, text). A book's file travels once, to its
    passages; equal passages of a book are looked up once. Null passages and books
    without a file have line 0; so has every passage in an empty file.
    """
    own = errors.withColumn("__passage", clean_search(F.col(passage)))
    asked = own.filter("__passage is not null").select(F.col(book).alias("book"), F.col("__passage").alias("passage")).distinct().withColumn("row", F.col("passage"))
    lines = files.select(F.col(book).alias("book"), file_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    kind = dict(asked.dtypes)["book"]
    found = asked.groupBy("book").cogroup(lines.groupBy("book")).applyInArrow(_finder, f"book {kind}, row string, line long")
    met = own.join(found.toDF("__book", "__row", "__line"), (F.col(book) == F.col("__book")) & (F.col("__passage") == F.col("__row")), "left")
    return met.withColumn("pg_file_line", F.coalesce("__line", F.lit(0).cast("long"))).drop("__passage", "__book", "__row", "__line")


def line_context(located: DataFrame, files: DataFrame, book: str = "book_id", text: str = "html") -> DataFrame:
    """Located with `context`: the line before, the line itself with a mark, and the line after; empty ones are left out."""
    lines = files.select(F.col(book).alias("__b"), F.posexplode(file_lines(F.coalesce(F.col(text), F.lit("")))).alias("__n", "__line")).withColumn("__n", (F.col("__n") + 1).cast("long"))
    places = located.select(F.col(book).alias("__b"), F.col("pg_file_line").alias("__at")).filter("__at > 0").distinct()
    near = places.withColumn("__n", F.explode(F.sequence(F.col("__at") - 1, F.col("__at") + 1))).join(lines, ["__b", "__n"])
    said = F.concat(F.lit("Line "), F.col("__n").cast("string"), F.lit(": "), F.col("__line"), F.when(F.col("__n") == F.col("__at"), "  <-- error here").otherwise(""))
    rows = near.filter("__line <> ''").groupBy("__b", "__at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", said.alias("said")))), lambda x: x["said"]), "\n").alias("context"))
    return located.join(rows, (F.col(book) == F.col("__b")) & (F.col("pg_file_line") == F.col("__at")), "left").drop("__b", "__at").withColumn("context", F.coalesce("context", F.lit("")))


def location(chapter: Column, line: Column) -> Column:
    """A line of text that says where an error is."""
    return F.concat_ws("; ", F.when(chapter != "", F.concat(F.lit("Chapter: "), chapter)), F.when(line > 0, F.concat(F.lit("Line "), line.cast("string"))))


def leaf_number(image: Column, page: Column) -> Column:
    """The scan viewer's number of a page, one less than that of its image file; the page itself without one."""
    number = F.regexp_extract(F.coalesce(image, F.lit("")), r"_(\d+)\.\w+$", 1)
    return F.when(number != "", number.cast("long") - 1).otherwise(page.cast("long"))

"""Editions as DataFrames: text files, page logs, transcriptions, stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.sources import html as web

# fixed values: the marks around a book's body, and the fields of its header
START, END = r"(?i)\*\*\* ?START OF (?:THIS |THE )?(?:THE )?PROJECT GUTENBERG[^\n]*\n", r"(?i)\*\*\* ?END OF (?:THIS |THE )?(?:THE )?PROJECT GUTENBERG"
FIELDS = {"title": "Title", "author": "Author", "language": "Language", "release_date": "Release Date", "encoding": "Character set encoding", "producer": "Produced by"}
SPECS = ("scan", "text", "pages", "transcribed")


def parse_spec(spec: str) -> tuple[str, str]:
    """Kind and place of `<kind>:<place>`; ValueError for an unknown kind."""
    kind, colon, place = spec.partition(":")
    if not colon or kind not in SPECS or not place:
        raise ValueError(f"not one of {', '.join(f'{k}:...' for k in SPECS)}: {spec!r}")
    return kind, place


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content), a file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def book_id(path: Column, content: Column) -> Column:
    """The first digits of the file's name, else the number that the text gives."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    tries = [F.regexp_extract(name, r"([0-9]+)", 1), F.regexp_extract(content, r"(?i)EBook #([0-9]+)", 1), F.regexp_extract(content, r"(?i)GUTENBERG EBOOK ([0-9]+)", 1)]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in tries), F.lit("0")).cast("long")


def body(content: Column) -> Column:
    """The text between the marks, or all of it."""
    after = F.coalesce(F.get(F.split(content, START, 2), F.lit(1)), content)
    return F.get(F.split(after, END, 2), F.lit(0))


def header(content: Column) -> Column:
    parts = F.split(content, START, 2)
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(""))


def text_paragraphs(content: Column) -> Column:
    """Paragraphs with their lines joined."""
    return F.filter(F.transform(F.split(body(content), r"\n\s*\n"), lambda x: T.squeeze(x)), lambda x: x != "")


def parse_books(files: DataFrame) -> DataFrame:
    """(book_id, metadata fields, paragraphs, body_text) of text and HTML files."""
    c = F.col("content")
    is_html = F.lower("path").rlike(r"\.html?$")
    fields = [F.nullif(F.trim(F.regexp_extract(header(c), rf"(?m)^{label}:?\s*(.+)", 1)), F.lit("")).alias(name) for name, label in FIELDS.items() if name != "title"]
    title = F.when(is_html, F.trim(F.regexp_extract(c, r"(?is)<h1[^>]*>(.*?)</h1>", 1))).otherwise(F.trim(F.regexp_extract(header(c), r"(?m)^Title:\s*(.+)", 1)))
    paragraphs = F.when(is_html, web.paragraphs(c)).otherwise(text_paragraphs(c))
    own = files.select(book_id(F.col("path"), c).alias("book_id"), F.nullif(title, F.lit("")).alias("title"), *fields, paragraphs.alias("paragraphs"))
    return own.withColumn("body_text", F.array_join("paragraphs", "\n\n"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of transcriptions, one JSON object a line; broken lines are left out, a page's last line counts."""
    schema = "page_num long, transcription string, transcription_cleaned string, model_used string, success boolean, error string, __bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "__bad").json(path)
    own = rows.withColumn("__at", F.monotonically_increasing_id()).filter("__bad is null and page_num is not null")
    last = F.row_number().over(Window.partitionBy("page_num").orderBy(F.col("__at").desc()))
    return own.withColumn("__n", last).filter("__n = 1").drop("__n", "__at", "__bad")


def best_pages(log: DataFrame) -> DataFrame:
    """(page_num, text) of successful pages."""
    return log.filter("success").select("page_num", F.coalesce(F.nullif("transcription_cleaned", F.lit("")), "transcription").alias("text"))


def valid_cache(cache: DataFrame, images: DataFrame, model: str) -> DataFrame:
    """Cached transcriptions of images (filename, content) whose hash and model still hold."""
    hashed = images.select("filename", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("image_hash"))
    return cache.filter((F.col("model") == model) & F.col("success")).join(hashed, ["filename", "image_hash"], "left_semi")


def synthetic_pages(text: str, chunk: int = 2000) -> list[str]:
    """Paragraphs packed in order into pages of about `chunk` characters; none is cut."""
    pages: list[list[str]] = []
    size = 0
    for p in (x.strip() for x in text.split("\n\n")):
        if not p:
            continue
        if pages and size + len(p) <= chunk:
            pages[-1].append(p)
            size += len(p) + 2
        else:
            pages.append([p])
            size = len(p)
    return ["\n\n".join(p) for p in pages]


def volume_pages(files: DataFrame) -> DataFrame:
    """Pages of (volume, page) numbered on from volume to volume; a volume's first number is the sum of those before."""
    counts = files.groupBy("volume").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("volume").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = files.withColumn("i", F.row_number().over(Window.partitionBy("volume").orderBy("page")) - 1)
    return own.join(base, "volume").withColumn("page_num", F.col("base") + F.col("i")).drop("n", "base", "i")

"""OCR text out of given files: character XML, plain or gzipped, and plain text."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _name(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def xml_lines(data: bytes) -> str | None:
    """The lines of a character XML file, in any namespace; None for what isn't XML or has no text.

    A line is the text of its characters, or, in files without any, of all it holds.
    """
    try:
        text = gzip.decompress(data).decode("utf-8", "replace")
    except (OSError, EOFError):
        text = data.decode("utf-8", "replace")
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return None
    lines = [x for x in root.iter() if _name(x.tag) == "line"]
    for chosen in (("charParams",), None):
        said = ["".join(y.text or "" for y in x.iter() if chosen is None or _name(y.tag) in chosen) for x in lines]
        said = [x for x in said if x.strip()]
        if said:
            return "\n".join(said)
    return None


def read_xml(content: Column) -> Column:
    """S38 of a binary column; null stays null."""

    @F.pandas_udf(StringType())
    def read(files: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else xml_lines(bytes(x)) for x in files], dtype="object")

    return read(content)


def ocr_text(files: DataFrame, book: str = "book_id", name: str = "name", content: str = "content") -> DataFrame:
    """(book, ocr_text) from files (book, name, content): the XML's lines, else the plain text, of several the first by name; blank ones have no row."""
    n = F.col(name)
    xml = n.endswith("_abbyy.gz") | F.lower(n).contains("abbyy")
    plain = n.endswith("_djvu.txt") | (F.lower(n).contains("djvu") & n.endswith(".txt"))
    read = files.select(book, F.when(xml, 1).when(plain, 2).alias("rank"), n.alias("__name"), F.when(xml, read_xml(F.col(content))).when(plain, F.col(content).cast("string")).alias("ocr_text"))
    told = read.filter(F.col("rank").isNotNull() & (F.trim(F.regexp_replace("ocr_text", r"\s+", " ")) != ""))
    return told.groupBy(book).agg(F.min_by("ocr_text", F.struct("rank", "__name")).alias("ocr_text"))

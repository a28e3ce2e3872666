"""HTML editions by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTITIES = (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_DROP = r"(?is)<(script|style|head)\b.*?</(script|style|head)>|<!--.*?-->"
_BREAK = r"(?i)<(p|div|h[1-6]|li|ul|nav|article|footer|br|tr|td|table|blockquote)\b[^>]*>"


def paragraphs(html: Column) -> Column:
    """The lines of text between block tags."""
    body = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(html, _DROP, ""), _BREAK, "\n")), "<[^>]+>", "")
    for entity, char in _ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def metadata(pages: DataFrame) -> DataFrame:
    """Heading, title, declared language and number of each page."""
    h = F.col("html")
    heading = F.trim(F.regexp_replace(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    number = F.coalesce(F.nullif(F.regexp_extract("url", "([0-9]+)", 1), F.lit("")), F.lit("0")).cast("long")
    return pages.select("page_id", heading.alias("heading"), F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.lower(F.regexp_extract(h, r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1)).alias("lang"), number.alias("book_id"))

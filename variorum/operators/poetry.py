"""Poetry pages: responses of a model to typed stanzas, and poems that run over pages."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "struct<text:string,indent:int>"
PAGE = f"struct<poem_title:string,is_continuation:boolean,stanzas:array<struct<stanza_number:int,label:string,lines:array<{LINE}>>>>"


def _lines(raw: object) -> list[dict]:
    out = []
    for x in raw if isinstance(raw, list) else []:
        if isinstance(x, dict):
            out.append({"text": str(x.get("text", "")), "indent": int(x.get("indent", 0) or 0)})
        elif isinstance(x, list) and x:
            out.append({"text": str(x[0]), "indent": int(x[1]) if len(x) > 1 and isinstance(x[1], (int, float)) else 0})
        elif isinstance(x, str):
            out.append({"text": x, "indent": 0})
    return out


def parse_response(response: str) -> dict:
    """The JSON object of a response, bare, fenced or within text; else its ["line", n] pairs; else its lines."""
    response = response or ""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", response, re.S)
    span = response[response.find("{") : response.rfind("}") + 1]
    for text in (response, fenced[1] if fenced else "", span):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        if isinstance(found, dict):
            stanzas = [{"stanza_number": int(s.get("stanza_number", k + 1) or k + 1), "label": str(s.get("label", "") or ""), "lines": _lines(s.get("lines"))} for k, s in enumerate(found.get("stanzas") or []) if isinstance(s, dict)]
            return {"poem_title": str(found.get("poem_title", "") or ""), "is_continuation": bool(found.get("is_continuation")), "stanzas": stanzas}
    pairs = re.findall(r"\[\s*\"((?:[^\"\\]|\\.)*)\"\s*,\s*(\d+)\s*\]", response)
    lines = [{"text": json.loads(f'"{t}"'), "indent": int(n)} for t, n in pairs] or [{"text": x, "indent": 0} for x in response.split("\n") if x.strip()]
    return {"poem_title": "", "is_continuation": False, "stanzas": [{"stanza_number": 1, "label": "", "lines": lines}] if lines else []}


def parse(pages: DataFrame, response: str = "response") -> DataFrame:
    """Pages with the typed column `poem`; a null response is an empty page."""

    @F.pandas_udf(PAGE)
    def typed(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_response(x) for x in s], columns=["poem_title", "is_continuation", "stanzas"])

    return pages.withColumn("poem", typed(response))


def transcription(poem: Column) -> Column:
    """The lines as text, indented, with a blank line between stanzas."""
    return F.array_join(F.transform(poem["stanzas"], lambda s: F.array_join(F.transform(s["lines"], lambda x: F.concat(F.repeat(F.lit(" "), x["indent"]), x["text"])), "\n")), "\n\n")


def merge(pages: DataFrame, page: str = "page_num") -> DataFrame:
    """(poem_title, pages, stanzas) of poems over their pages in order, stanzas numbered anew. Untitled pages stay apart."""
    titled = pages.withColumn("title", F.when(F.col("poem.poem_title") == "", F.concat(F.lit("page "), F.col(page).cast("string"))).otherwise(F.col("poem.poem_title")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col("poem.stanzas").alias("stanzas"))))
    own = titled.groupBy("title").agg(ordered.alias("parts"))
    all_stanzas = F.flatten(F.transform("parts", lambda p: p["stanzas"]))
    numbered = F.transform(all_stanzas, lambda s, i: F.struct((i + 1).cast("int").alias("stanza_number"), s["label"].alias("label"), s["lines"].alias("lines")))
    return own.select(F.col("title").alias("poem_title"), F.transform("parts", lambda p: p["page"]).alias("pages"), numbered.alias("stanzas"))

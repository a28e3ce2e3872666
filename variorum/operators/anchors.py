"""Unique-word anchors of a page in a book, where prose begins, and correction of drifting alignments."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\b[a-z0-9]+\b")
# fixed values of the anchors and of the validation
LEAST_WORD, SPREAD, KEPT = 4, 3000, 2000
TOLERANCE, GOOD, FIT, SLOPE, SCATTER, LEAST_SAMPLES, SECOND_SHIFT = 500, 0.8, 0.30, 10, 1500, 5, 50


def increasing(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The longest run of (page, book, char) pairs in which both orders agree; pairs are of distinct words, so this is their LCS."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b, _) in enumerate(pairs):
        i = bisect_left(tails, b)
        if i == len(tails):
            tails.append(b)
            at.append(k)
        else:
            tails[i], at[i] = b, k
        back.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def unique_anchors(page: str, book: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """(word in the page, word in the book, character in the book) of words that both have once, in one order."""
    own = [m[0] for m in _TOKEN.finditer(page.lower())]
    there = [(m[0], m.start()) for m in _TOKEN.finditer(book.lower())]
    if min(len(own), len(there)) < 3:
        return []
    once = {w for w, n in Counter(own).items() if n == 1 and len(w) >= LEAST_WORD}
    once &= {w for w, n in Counter(w for w, _ in there).items() if n == 1}
    place = {w: (k, c) for k, (w, c) in enumerate(there) if w in once}
    pairs = [(k, *place[w]) for k, w in enumerate(own) if w in once and start <= place[w][1] < (len(book) if end is None else end)]
    found = increasing(pairs)
    if len(found) > 1 and max(x[2] for x in found) - min(x[2] for x in found) > SPREAD:
        found = [x for x in found if abs(x[2] - found[0][2]) <= KEPT]
    return found


def page_start(anchors: list[tuple[int, int, int]], page: str) -> int | None:
    """The median of where each anchor puts the page's start; None without anchors."""
    words = len(_TOKEN.findall(page.lower()))
    if not anchors or not words:
        return None
    return int(median(max(0.0, c - k * len(page) / words) for k, _, c in anchors))


def place_pages(pages: DataFrame, books: DataFrame, book: str = "conv_id", page: str = "turn", text: str = "text") -> DataFrame:
    """(book, page, n_anchors, start) of pages in their book's text by unique words; books are dealt out by key."""

    def fold(own: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        full = base["book_text"].iloc[0] if len(base) else ""
        rows = []
        for r in own.itertuples():
            words = getattr(r, text) or ""
            found = unique_anchors(words, full)
            rows.append((getattr(r, book), getattr(r, page), len(found), page_start(found, words)))
        out = pd.DataFrame(rows, columns=[book, page, "n_anchors", "start"])
        return out.astype({"start": "Int64"})

    return pages.select(book, page, text).groupBy(book).cogroup(books.groupBy(book)).applyInPandas(fold, f"{book} long, {page} long, n_anchors long, start long")


def body_start(text: Column) -> Column:
    """The offset of the first prose paragraph after the first chapter heading, among the next 50 paragraphs; 0 for none."""
    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  a value named and computed once a row, which optimised plans would repeat at each use
    heading = lambda p: p.rlike(r"(?i)^(CHAPTER|PART|Book|Section|ACT|I+\.\s+)")
    lines = lambda p: F.filter(F.split(p, "\n"), lambda x: F.trim(x) != "")
    prose = lambda p, n, ends: (n >= 150) & (ends >= 3) & ~F.forall(lines(p), lambda x: F.length(x) < 100)

    def mark(p: Column, i: Column) -> Column:
        n = F.length(p)
        # nothing below 150 characters is prose, so that its sentences aren't counted
        ends = F.when(n >= 150, F.regexp_count(p, F.lit(r"[.!?]\s+[A-Z\"]"))).otherwise(0)
        told = lambda x: F.struct(i.alias("i"), n.alias("n"), (heading(p) & ~x["noise"]).alias("head"), (~x["noise"] & prose(p, n, x["ends"])).alias("prose"), (~x["noise"] & (n > 500) & (x["ends"] >= 5)).alias("long"))
        return once(F.struct(p.rlike(r"[{}]|margin-|font-").alias("noise"), ends.alias("ends")), told)

    def offset(marked: Column) -> Column:
        least = lambda kept: F.array_min(F.transform(F.filter(marked, kept), lambda x: x["i"]))

        def from_first(first: Column) -> Column:
            near = least(lambda x: x["prose"] & (x["i"] >= first) & (x["i"] < first + 50))
            return once(F.coalesce(near, least(lambda x: x["long"])), lambda found: F.when(found.isNull(), 0).otherwise(F.aggregate(F.slice(marked, F.lit(1), found), F.lit(0), lambda s, x: s + x["n"] + 2)))

        return once(F.coalesce(least(lambda x: x["head"]), F.lit(0)), from_first)

    paras = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p, F.lit(" \n\t\r"))), lambda p: p != "")
    # a null text has no paragraphs
    return once(F.coalesce(paras, F.array().cast("array<string>")), lambda p: once(F.transform(p, mark), offset))


def correct(alignments: DataFrame, offsets: DataFrame, book: str = "book_id") -> DataFrame:
    """Alignments (book, scan_page, pg_start, pg_end, confidence) with corrected positions and the book's verdict.

    offsets (book, scan_page, found) says where sampled pages really stand. Books
    whose samples are mostly right stay as they are; a straight drift is taken out
    along its line and its rest once more; a moderate scatter is shifted by its mean
    and loses its least sure fifth; the others are given up. Fewer than five samples
    decide nothing. A book's pages are one task's work.
    """

    def fold(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own = own.copy()
        own["verdict"] = "unknown"
        seen = found.merge(own.sort_values("confidence").drop_duplicates("scan_page", keep="last"), on="scan_page") if len(found) and len(own) else found.assign(pg_start=0)
        if len(seen) < LEAST_SAMPLES or not len(own):
            return own
        x, y = seen["scan_page"].astype(float), (seen["found"] - seen["pg_start"]).astype(float)
        sigma = float(y.std(ddof=0))
        spread = float(((x - x.mean()) ** 2).sum())
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / spread) if spread else 0.0
        rest = y - y.mean() - slope * (x - x.mean())
        if (y.abs() < TOLERANCE).mean() >= GOOD:
            return own.assign(verdict="ok")

        def moved(by: pd.Series | int) -> pd.DataFrame:
            out = own.copy()
            out["pg_start"] = (out["pg_start"] + by).clip(lower=0).astype("int64")
            out["pg_end"] = (out["pg_end"] + by).clip(lower=out["pg_start"]).astype("int64")
            return out

        if float(rest.std(ddof=0)) / max(sigma, 1.0) < FIT and abs(slope) > SLOPE:
            line = (y.mean() + slope * (own["scan_page"] - x.mean())).round().astype("int64")
            own = moved(line)
            again = round(float(rest.mean()))
            return (moved(again) if abs(again) > SECOND_SHIFT else own).assign(verdict="drift_corrected")
        if sigma < SCATTER:
            out = moved(round(float(y.mean()))).assign(verdict="corrected")
            return out[out["confidence"] >= sorted(out["confidence"])[len(out) // 5]]
        return own.assign(verdict="failed")

    schema = ", ".join(f"`{c}` {t}" for c, t in alignments.dtypes) + ", verdict string"
    return alignments.groupBy(book).cogroup(offsets.select(book, "scan_page", "found").withColumnRenamed(book, "__book").groupBy("__book")).applyInPandas(lambda a, b: fold(a, b.drop(columns="__book")), schema)

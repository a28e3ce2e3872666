"""Alignment of pages with a base text: phrases, placement, windows; sentence LCS; drift."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions.lexicon import COMMON_WORDS
from variorum.runtime import dealt

# fixed values of the placement: window scales, least window and score, what a step back may be
SCALES, LEAST_WINDOW, LEAST_SCORE, STEP_BACK = (0.7, 0.85, 1.0, 1.15), 200, 0.35, 200
LEAST_PHRASE = 8  # fixed value: the words of the shortest phrase
_WORD = re.compile(r"\b[a-zA-Z]+\b")


def letter_words(c: Column) -> Column:
    """Lower-case words of ASCII letters alone."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])"), F.lit(0))


#: a table of phrases this small is broadcast; a larger one is joined by their hashes
BROADCAST_ROWS = 200_000


def phrase_hits(docs: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
    """(doc_id, item_id, word_pos) of k-word phrases.

    Runs of k words are hashes, which meet those of the phrases; where they do, the
    words themselves decide. Rows with a null doc_id aren't reported.
    """
    own = docs.select("doc_id", letter_words(F.col("text")).alias("w")).filter("doc_id is not null")
    runs = own.filter(F.size("w") >= k).select("doc_id", F.posexplode(F.expr(f"transform(sequence(1, size(w) - {k - 1}), i -> xxhash64(slice(w, i, {k})))")).alias("word_pos", "h"))
    probes = phrases.select("item_id", "phrase", F.xxhash64("phrase").alias("h"))
    if probes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        probes = F.broadcast(probes)
    met = runs.join(probes, "h").select("doc_id", "item_id", "word_pos", "phrase")
    places = met.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "word_pos", "phrase")).alias("x"))
    sure = own.join(places, "doc_id").select("doc_id", F.explode(F.expr(f"filter(x, y -> slice(w, y.word_pos + 1, {k}) = y.phrase)")).alias("y"))
    return sure.select("doc_id", "y.item_id", F.col("y.word_pos").cast("long").alias("word_pos")).distinct()


def distinctive_phrases(pages: DataFrame, keys: list[str], text: str = "text", skip: int = 60, least_words: int = LEAST_PHRASE, most: int = 5) -> DataFrame:
    """(keys, rank, phrase) of each page's longest sentences with rare words."""
    body = F.substring(F.col(text), skip + 1, 1 << 30)
    long = lambda parts, n: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > n)
    by_mark, by_semicolon = long(F.split(body, r"(?<=[.!?])\s+"), 30), long(F.split(body, r";\s+"), 40)
    sentences = F.when(F.size(by_mark) > 0, by_mark).otherwise(by_semicolon)
    own = pages.filter(F.length(text) >= skip + 20).select(*keys, F.posexplode(sentences).alias("pos", "s")).select(*keys, "pos", letter_words(F.col("s")).alias("w")).filter(F.size("w") >= least_words)
    rare = F.size(F.filter("w", lambda x: (F.length(x) > 3) & ~x.isin(*COMMON_WORDS)))
    order = Window.partitionBy(*keys).orderBy((F.size("w") + 2 * rare).desc(), "pos")
    ranked = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select(*keys, "rank", F.when(F.size("w") > 25, F.slice("w", 1, 20)).otherwise(F.col("w")).alias("phrase"))


def place_monotonic(candidates: list[tuple[int, list[tuple[int, float]]]]) -> dict[int, int]:
    """Of each page's (position, score) candidates one, in page order, not before the last page's.

    A page without such a candidate may step back a little, else it takes its first.
    From three placed pages on, candidates near the expected place are preferred.
    """
    placed: list[tuple[int, int]] = []
    for page, options in candidates:
        if not options:
            continue
        floor = placed[-1][1] if placed else 0
        fits = [c for c in options if c[0] >= floor] or [c for c in options if c[0] >= floor - STEP_BACK] or options[:1]
        recent = placed[-5:]
        expected = pace = None
        if len(placed) >= 3:
            pages = recent[-1][0] - recent[0][0]
            rate = (recent[-1][1] - recent[0][1]) / max(1, pages)
            expected = recent[-1][1] + rate * (page - recent[-1][0]) if pages > 0 else floor
            pace = max(500, rate)

        def worth(c: tuple[int, float], expected=expected, pace=pace) -> float:
            near = max(0.0, 1 - abs(c[0] - expected) / (4 * pace)) if expected and expected > 0 else 1.0
            return 0.7 * c[1] + 0.3 * near

        placed.append((page, max(fits, key=worth)[0]))
    return dict(placed)


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def windows(book: str, texts: dict[int, str], placed: dict[int, int]) -> list[tuple[int, int, int, float]]:
    """(page, start, end, score): of several windows about each place the most similar one, between its neighbours' midpoints."""
    order = sorted(placed)
    lengths = [len(texts[p]) for p in order if texts.get(p)][:10]
    average = sum(lengths) / len(lengths) if lengths else 1500
    stretch = len(book) / max(1, len(order)) / average if average else 1.2
    out = []
    for i, page in enumerate(order):
        text = texts.get(page, "")
        if len(text) < 50:
            continue
        at = placed[page]
        low = (placed[order[i - 1]] + at) // 2 if i else 0
        high = (at + placed[order[i + 1]]) // 2 if i + 1 < len(order) else len(book)
        words, best = _words(text), None
        for scale in SCALES:
            size = int(int(len(text) * stretch) * scale)
            start = max(low, at - size // 2)
            end = min(high, at - size // 2 + size)
            if end - start < LEAST_WINDOW or start < 0 or end > len(book):
                continue
            other = _words(book[start:end])
            score = SequenceMatcher(None, words, other).ratio() if words and other else 0.0
            if best is None or score > best[2]:
                best = (start, end, score)
        if best and best[2] >= LEAST_SCORE:
            out.append((page, *best))
    return out


def global_align(pages: DataFrame, books: DataFrame, book: str = "conv_id", page: str = "turn", text: str = "text") -> DataFrame:
    """(book, scan_page, pg_start, pg_end, confidence) of pages in their book's text.

    Phrases are found by a join on the hash of their first LEAST_PHRASE words, which
    all have; the order of pages and the windows are folds over one book, which is a
    task's work. Books are dealt out by their key.
    """
    phrases = distinctive_phrases(pages.filter(F.length(text) >= 50), [book, page], text)
    probes = phrases.select(book, page, "phrase", F.xxhash64(F.slice("phrase", 1, LEAST_PHRASE)).alias("h"))
    words = books.select(book, letter_words(F.col("book_text")).alias("w"))
    runs = words.filter(F.size("w") >= LEAST_PHRASE).select(book, F.posexplode(F.expr(f"transform(sequence(1, size(w) - {LEAST_PHRASE - 1}), i -> xxhash64(slice(w, i, {LEAST_PHRASE})))")).alias("word_pos", "h"))
    hits = runs.join(probes, [book, "h"]).groupBy(book, page).agg(F.collect_set(F.struct("word_pos", "phrase")).alias("hits"))
    bases = books.select(book, "book_text", letter_words(F.col("book_text")).alias("w"))
    rows = pages.join(hits, [book, page], "left").select(book, page, F.col(text).alias("page_text"), "hits")

    def fold(own: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(own):
            return pd.DataFrame({book: [], "scan_page": [], "pg_start": [], "pg_end": [], "confidence": []}).astype({book: "int64", "scan_page": "int64", "pg_start": "int64", "pg_end": "int64", "confidence": "float64"})
        full = base["book_text"].iloc[0]
        starts, words = [m.start() for m in _WORD.finditer(full)], list(base["w"].iloc[0])
        candidates, texts = [], {}
        for r in own.sort_values(page).itertuples():
            texts[int(getattr(r, page))] = r.page_text or ""
            # the runs met by the hash of their first words; all words decide
            found = [(int(h["word_pos"]), list(h["phrase"])) for h in (r.hits if r.hits is not None else [])]
            sure = sorted({(at, min(1.0, len(own) / 12.0)) for at, own in found if words[at : at + len(own)] == own})
            candidates.append((int(getattr(r, page)), [(starts[at], score) for at, score in sure if at < len(starts)]))
        out = windows(full, texts, place_monotonic(candidates))
        return pd.DataFrame([(own[book].iloc[0], *x) for x in out], columns=[book, "scan_page", "pg_start", "pg_end", "confidence"])

    return dealt(rows, book).groupBy(book).cogroup(dealt(bases, book).groupBy(book)).applyInPandas(fold, f"{book} long, scan_page long, pg_start long, pg_end long, confidence double")


# --- sentence LCS


def lcs_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The index pairs of a longest common subsequence; ties go up the first sequence."""
    names: dict[str, int] = {}
    x, y = (np.array([names.setdefault(s, len(names)) for s in part], np.int64) for part in (a, b))
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (y == x[i])))
    out, i, j = [], len(a), len(b)
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def sentence_chunks(text: str, least: int = 15) -> list[str]:
    parts = [p.strip() for p in re.split(r"[.!?;]\s+", text)]
    long = [p for p in parts if len(p) >= least]
    if len(long) <= 1:
        lines = [x.strip() for x in text.split("\n") if len(x.strip()) >= least]
        long = lines if len(lines) > 1 else long
    return long


def coarse_groups(a: str, b: str) -> list[tuple[int, int, float]]:
    """(start, end, confidence) in a of runs of common sentences, five apart at most."""
    xs, ys = sentence_chunks(a), sentence_chunks(b)
    plain = lambda s: re.sub(r"[^\w\s]", "", " ".join(s.lower().split()))
    pairs = lcs_pairs([plain(s) for s in xs], [plain(s) for s in ys])
    starts, at = [], 0
    for s in xs:
        found = a.find(s[:50], at)
        starts.append(at if found < 0 else found)
        at = starts[-1] + len(s)
    starts.append(len(a))
    out: list[list[tuple[int, int]]] = []
    for p in pairs:
        if out and p[0] - out[-1][-1][0] <= 5 and p[1] - out[-1][-1][1] <= 5:
            out[-1].append(p)
        else:
            out.append([p])
    return [(starts[g[0][0]], starts[g[-1][0] + 1], min(1.0, len(g) / (g[-1][0] - g[0][0] + 1))) for g in out]


def coarse_align(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """A21 for each row of pairs: (key, seq, pg_start, pg_end, confidence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, *g) for k, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for n, g in enumerate(coarse_groups(x or "", y or ""))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[key, "seq", "pg_start", "pg_end", "confidence"])

    return pairs.select(F.col(key).cast("long").alias(key), a, b).mapInArrow(run, f"{key} long, seq int, pg_start long, pg_end long, confidence double")


# --- validation


def drift(alignments: DataFrame, book: str = "conv_id") -> DataFrame:
    """Slope, intercept and spread of the positions of books with three alignments or more."""
    own = alignments.groupBy(book).agg(F.round(F.regr_slope("pg_start", "scan_page"), 4).alias("slope"), F.round(F.regr_intercept("pg_start", "scan_page"), 4).alias("intercept"), F.round(F.stddev_pop("pg_start"), 4).alias("sigma"), F.count("*").alias("n"))
    return own.filter("n >= 3")


def systematic(alignments: DataFrame, wanted: int, book: str = "conv_id") -> DataFrame:
    """W13."""
    w = Window.partitionBy(book)
    own = alignments.withColumn("__i", F.row_number().over(w.orderBy("scan_page")) - 1).withColumn("__n", F.count("*").over(w))
    return own.filter(F.col("__i") % F.greatest(F.lit(1), F.floor(F.col("__n") / wanted)) == 0).drop("__i", "__n")


def without_lowest_fifth(alignments: DataFrame, book: str = "conv_id") -> DataFrame:
    """Rows of at least the confidence that stands a fifth up in order."""
    at = F.sort_array(F.collect_list("confidence"))
    least = alignments.groupBy(book).agg(F.get(at, F.floor(F.size(at) / 5).cast("int")).alias("__least"))
    return alignments.join(least, book).filter(F.col("confidence") >= F.col("__least")).drop("__least")

"""Text of pages that the base text lacks: uncovered pages, partial pages, holes in aligned passages."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import runs
from variorum.functions import text as T
from variorum.functions.lexicon import HOLE_STOPS
from variorum.runtime import dealt

# fixed values: least words of a gap, anchors of a hole, coverage and confidence limits, the window of the look-up
MIN_GAP, MIN_ANCHOR, MIN_COVERAGE, MIN_CONFIDENCE, WINDOW, FUZZY, FUZZY_WORDS = 5, 4, 0.6, 0.65, 25, 0.6, 5000
REPORT_WORDS = {"uncovered": 50, "partial": 30, "content_hole": 5}


def confidence(words: Column, verified: Column, non_content: Column) -> Column:
    """M35."""
    return F.when(non_content, "low").when(verified, F.when(words >= 50, "high").when(words >= 20, "medium").otherwise("low")).otherwise(F.when(words >= 100, "medium").otherwise("low"))


def uncovered(pages: DataFrame, alignments: DataFrame, book: str = "conv_id", page: str = "turn") -> DataFrame:
    """A69's first strategy: pages without an alignment (J4), without a look into the base text."""
    own = pages.join(alignments.select(book, F.col("scan_page").alias(page)).distinct(), [book, page], "left_anti")
    body = own.select(book, F.col(page).alias("page"), T.strip_page_header(F.col("page_text")).alias("t"))
    body = body.withColumn("word_count", F.size(T.tokens(F.col("t"))).cast("long")).filter(F.col("word_count") >= MIN_GAP)
    return body.withColumn("non_content", T.is_non_content(F.col("t"))).withColumn("confidence", confidence(F.col("word_count"), F.lit(False), F.col("non_content")))


def _plain(text: str) -> list[str]:
    return re.sub(r"[^\w\s]", "", text.lower()).split()


class BookIndex:
    """A book's word runs, indexed once per book and length."""

    def __init__(self, text: str, fuzzy_words: int | None = FUZZY_WORDS):
        self.text, self.words, self.fuzzy_words = text.lower(), _plain(text), fuzzy_words
        self.runs: dict[int, set[str]] = {}
        self.windows: dict[int, list[str]] = {}

    def apart(self, size: int) -> list[str]:
        if size not in self.windows:
            self.windows[size] = [" ".join(self.words[i : i + size]) for i in range(0, len(self.words) - size + 1, max(10, size))]
        return self.windows[size]

    def holds(self, gap: str) -> tuple[bool, float]:
        """Whether a window of the gap's words stands in the book, exactly or nearly, and how nearly."""
        words = gap.split()
        size = min(WINDOW, len(words))
        if len(words) < 5 or len(self.words) < max(10, size):
            return False, 0.0
        if size not in self.runs:
            self.runs[size] = {" ".join(self.words[i : i + size]) for i in range(len(self.words) - size + 1)}
        best = 0.0
        for start in dict.fromkeys([0, *([(len(words) - size) // 2] if len(words) > 2 * size else []), *([len(words) - size] if len(words) > size else [])]):
            own = " ".join(_plain(" ".join(words[start : start + size])))
            if own in self.runs[size]:
                return True, 1.0
            if self.fuzzy_words is None or len(self.words) <= self.fuzzy_words:
                for window in self.apart(size):
                    best = max(best, runs.ratio(own, window))
                    if best >= FUZZY:
                        return True, best
        return False, best


def partial(index: BookIndex, passage: str, page: str) -> list[tuple[str, int, float, float, bool]]:
    """A69's second strategy: (text, words, coverage, ratio, verified) of unmatched runs of a page that its passage covers too little."""
    scan = page.split()
    base = passage.split()
    if len(scan) < MIN_GAP or len(base) / len(scan) >= MIN_COVERAGE:
        return []
    matched = [False] * len(scan)
    for m in SequenceMatcher(None, base, scan, autojunk=False).get_matching_blocks():
        matched[m.b : m.b + m.size] = [True] * m.size
    out, i = [], 0
    while i < len(scan):
        j = i
        while j < len(scan) and not matched[j]:
            j += 1
        if j - i >= MIN_GAP:
            gap = " ".join(scan[i:j])
            found, ratio = index.holds(gap)
            out.append((gap, j - i, len(base) / len(scan), ratio, not found))
        i = max(j, i + 1)
    return out


def holes(index: BookIndex, passage: str, page: str, least: int = MIN_GAP) -> list[tuple[str, int, str, str, str]]:
    """(words, count, confidence, before, after) of one-sided gaps between good anchors that the book lacks."""
    token = re.compile(r"[a-z0-9]+(?:'[a-z]+)?")
    base, scan, raw = token.findall(passage.lower()), token.findall(page.lower()), passage.split()
    if min(len(base), len(scan)) < 4:
        return []
    blocks = SequenceMatcher(None, base, scan, autojunk=False).get_matching_blocks()
    out = []
    for m, n in zip(blocks, blocks[1:], strict=False):
        if min(m.size, n.size) < MIN_ANCHOR:
            continue
        i, j = m.a + m.size, m.b + m.size
        gap = scan[j : n.b]
        if len(gap) < least or n.a - i > 1 or any(re.search(r"[.?!]\"?$", w) for w in raw[max(0, i - 5) : i]):
            continue
        words = " ".join(gap)
        if words in index.text or index.holds(words)[0]:
            continue
        level = "low" if all(w in HOLE_STOPS for w in gap) else "high" if len(gap) >= 8 else "medium"
        out.append((words, len(gap), level, " ".join(base[max(0, i - 3) : i]), " ".join(base[n.a : n.a + 3])))
    return out


_GAP = "page long, strategy string, word_count long, preview string, coverage_ratio double, pg_verified boolean, pg_match_ratio double, confidence string, missing_words string"


def all_gaps(pages: DataFrame, alignments: DataFrame, books: DataFrame, book: str = "conv_id", page: str = "turn", fuzzy_words: int | None = FUZZY_WORDS) -> DataFrame:
    """The gaps of all strategies (X8), each page against its own passage and its book's text.

    Pages of a book meet its text, which travels and is indexed once; books are
    dealt out by their key. Holes count once (Q8). Books of more than fuzzy_words
    words, by the rule 5000, are looked up exactly alone; None looks into all nearly too.
    """
    spans = alignments.groupBy(book, F.col("scan_page").alias(page)).agg(F.min("pg_start").alias("pg_start"), F.max("pg_end").alias("pg_end"), F.max("confidence").alias("confidence"))
    body = pages.select(book, page, T.strip_page_header(F.col("page_text")).alias("t"), F.col("page_text"))
    rows = body.withColumn("non_content", T.is_non_content(F.col("t"))).join(spans, [book, page], "left")
    own = rows.select(F.col(book).alias(book), F.col(page).alias("page"), "t", "page_text", "non_content", "pg_start", "pg_end", "confidence")

    def level(words: int, verified: bool, empty: bool) -> str:
        if empty or (verified and words < 20) or (not verified and words < 100):
            return "low"
        return "high" if verified and words >= 50 else "medium"

    def run(key: tuple, group: pa.Table, base: pa.Table) -> pa.Table:
        out = []
        text = base.column("book_text")[0].as_py() if base.num_rows else None
        if text is not None:
            index = BookIndex(text, fuzzy_words)
            group = group.sort_by("page")
            for b, p, t, whole, empty, start, end, sure in zip(*(group.column(i).to_pylist() for i in range(8)), strict=True):
                if start is None:
                    words = len(t.split())
                    if words >= MIN_GAP:
                        found, ratio = (False, 0.0) if empty else index.holds(t)
                        verified = not found and not empty
                        out.append((b, p, "uncovered", words, t[:500], 0.0, verified, ratio, level(words, verified, empty), ""))
                    continue
                passage = text[start:end]
                out += [(b, p, "partial", n, gap[:500], ratio, verified, near, level(n, verified, False), "") for gap, n, ratio, near, verified in partial(index, passage, t)]
                if sure >= MIN_CONFIDENCE:
                    out += [(b, p, "content_hole", n, words[:500], 0.0, True, 0.0, how, words) for words, n, how, _, _ in holes(index, passage, whole)]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.float64(), pa.string(), pa.string())
        names = [book, *(x.split()[0] for x in _GAP.split(", "))]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return dealt(own, book).groupBy(book).cogroup(dealt(books.select(F.col(book).alias("key"), "book_text"), "key").groupBy("key")).applyInArrow(run, f"{book} long, {_GAP}")


def for_report(gaps: DataFrame) -> DataFrame:
    """F21."""
    least = F.when(F.col("strategy") == "uncovered", REPORT_WORDS["uncovered"]).when(F.col("strategy") == "partial", REPORT_WORDS["partial"]).otherwise(REPORT_WORDS["content_hole"])
    return gaps.filter(F.col("confidence").isin("high", "medium") & (F.col("word_count") >= least))


def as_candidates(gaps: DataFrame) -> DataFrame:
    """Gaps as candidates of missing content."""
    n = F.col("word_count").cast("string")
    says = (
        F.when(F.col("strategy") == "content_hole", F.concat(F.lit("Scan page "), F.col("page"), F.lit(" has "), n, F.lit(' words missing from PG within an aligned passage: "'), F.substring("missing_words", 1, 100), F.lit('"')))
        .when(F.col("strategy") == "uncovered", F.concat(F.lit("Scan page "), F.col("page"), F.lit(" has ~"), n, F.lit(" words with no PG alignment and no match in PG text")))
        .otherwise(F.concat(F.lit("Scan page "), F.col("page"), F.lit(" has ~"), n, F.lit(" words not matched by PG text")))
    )
    kept = gaps.filter((F.col("strategy") != "content_hole") | (F.col("pg_verified") & F.col("confidence").isin("high", "medium")))
    return kept.select("*", F.lit("(not found in PG)").alias("pg_text"), F.col("preview").alias("scan_text"), F.lit(0).cast("long").alias("pg_offset"), says.alias("diff_description"), F.lit("missing_content").alias("category"))

"""Pages placed one after the other: by chapter heading, else near where the last pages ended, then gaps from both sides."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.operators import anchors
from variorum.runtime import dealt
from variorum.streaming import tracker

# fixed values: least scores of the passes, pages between fresh looks, the margin and reach of a repair, its rounds
BY_CHAPTER, NEAR_BY, REPAIRED, REANCHOR, MARGIN, REACH, ROUNDS = 0.50, 0.40, 0.35, 10, 500, 10000, 5
# fixed values: the least characters of a page, the least of a chapter, what is a copy, a fall in score, remembered scores
LEAST_PAGE, LEAST_CHAPTER, COPY, FALL, MEMORY, ENOUGH = 30, 1000, 0.9, 0.20, 10, 5
# fixed values: first lines that are no chapter titles, and the least likeness of a title
NO_TITLES, ALIKE = ("moby dick", "extracts", "etyymology", "contents", "preface", "introduction", "the end"), 0.75
_CHAPTER = re.compile(r"^CHAPTER\s+\d+[.\s]+", re.IGNORECASE)
_WORD = re.compile(r"\b[a-z0-9]+\b")


def heading(page: str) -> str | None:
    """The chapter title in a page's first line, or None."""
    line = next((x.strip() for x in page.split("\n") if x.strip()), "")
    named = re.match(_CHAPTER.pattern + "(.+)", line, re.IGNORECASE)
    if named:
        return named[1].strip().rstrip(".")
    if not line or len(line) >= 80 or line.isdigit():
        return None
    title = re.sub(r"[.;—–:]+\s*$", "", re.sub(r"\s+\d+$", "", line)).strip()
    words = title.split()
    if title.endswith(",") and len(words) == 1:
        return None
    title = title.rstrip(".")
    words = title.split()
    if title.lower() in NO_TITLES or not words or not all(w[0].isupper() for w in words if len(w) > 2):
        return None
    return title


def _plain(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", "", text.lower()).split())


def chapter_named(title: str | None, titles: list[str], current: int = 0) -> int | None:
    """The chapter with a page's title: an equal one before a like one, then the nearest to the current, then the likest."""
    if not title:
        return None
    wanted, found = _plain(title), []
    for k, own in enumerate(titles):
        name = _CHAPTER.sub("", own).strip().rstrip(".")
        if not name:
            continue
        if _plain(name) == wanted:
            found.append((False, abs(k - current), -1.0, k))
        elif min(len(_plain(name)), len(wanted)) > 4:
            like = SequenceMatcher(None, wanted, _plain(name)).ratio()
            if like > ALIKE:
                found.append((True, abs(k - current), -like, k))
    return min(found)[-1] if found else None


def consistent(last_end: int, last_page: int, start: int, page: int, pace: float) -> bool:
    """whether a page stands about where the pages in between let it: half to double of their length."""
    between = page - last_page - 1
    if between < 0:
        return True
    gap, due = start - last_end, pace * between
    return -pace * 0.5 <= gap <= pace * 2 if due <= 0 else due * 0.5 <= gap <= due * 2


def regressed(score: float, seen: list[float]) -> bool:
    """whether a score is a fifth below the mean of the last ones, five at least."""
    mean = sum(seen) / len(seen) if seen else 0.0
    return len(seen) >= ENOUGH and mean > 0 and (mean - score) / mean > FALL + 1e-9


class Copies:
    """Placed pages, of which another may be a copy; likeness is computed where lengths and letters don't rule it out."""

    def __init__(self) -> None:
        self.pages: dict[str, Counter[str]] = {}

    def add(self, page: str) -> None:
        if page not in self.pages:
            self.pages[page] = Counter(page)

    def holds(self, page: str) -> bool:
        own = None
        for other, letters in self.pages.items():
            both = len(page) + len(other)
            if both and 2.0 * min(len(page), len(other)) / both <= COPY:
                continue
            own = Counter(page) if own is None else own
            if both and 2.0 * sum(min(n, letters[c]) for c, n in own.items() if c in letters) / both <= COPY:
                continue
            if SequenceMatcher(None, page, other).ratio() > COPY:
                return True
        return False


class Book:
    """A book's words, read once, in which pages are looked for within windows."""

    def __init__(self, text: str):
        self.text = text
        self.words = [(m[0], m.start()) for m in _WORD.finditer(text.lower())]
        self.starts = [at for _, at in self.words]

    def find(self, page: str, low: int, high: int, least: float) -> tuple[int, int, float] | None:
        """(start, end, score) of the page in the window, by words that page and window have once; None below the least score."""
        own = [m[0] for m in _WORD.finditer(page.lower())]
        i, j = bisect_left(self.starts, low), bisect_left(self.starts, high)
        there = self.words[i:j]
        if min(len(own), len(there)) < 3:
            return None
        once = {w for w, n in Counter(own).items() if n == 1 and len(w) >= anchors.LEAST_WORD}
        once &= {w for w, n in Counter(w for w, _ in there).items() if n == 1}
        place = {w: (k, at) for k, (w, at) in enumerate(there) if w in once}
        found = anchors.increasing([(k, *place[w]) for k, w in enumerate(own) if w in once])
        start = anchors.page_start(found, page)
        if start is None:
            return None
        start = min(max(start, low), max(low, high - 1))
        end = min(high, start + max(anchors.LEAST_WORD, len(page)))
        base = [w for w, at in self.words[bisect_left(self.starts, start) : bisect_left(self.starts, end)]]
        score = SequenceMatcher(None, own, base).ratio() if base else 0.0
        return (start, end, score) if score >= least else None


def place(text: str, pages: list[tuple[int, str]], chapters: list[tuple[str, int, int]] = (), body: int = 0) -> dict[int, tuple[int, int, float, str]]:
    """Page -> (start, end, score, pass) of pages (number, text) in their order.

    A page whose first line names a chapter is looked for in it, any other one near
    where the pages before it end (A55). Where a page of the second kind is out of
    pace (F28) or falls off in score (F29), and at every tenth page (A57), the whole
    body is searched: a place further than one and a half pages from the expected one
    resets what is remembered. Copies of placed pages and pages of under 30
    characters are skipped. Last, pages without a place are looked for between their
    neighbours, up to five rounds.
    """
    book, placed, copies, seen, scores = Book(text), {}, Copies(), [], []
    texts = dict(pages)
    real = [c for c in chapters if c[2] - c[1] > LEAST_CHAPTER] or list(chapters)
    current = next((k for k, c in enumerate(real) if c[1] >= body), len(real) - 1)
    skipped, since = set(), 0

    def far(found: tuple[int, int, float], page: int) -> bool:
        return abs(found[0] - tracker.expected(seen, page)) > int(tracker.pace(seen) * 1.5)

    def note(page: int, found: tuple[int, int, float], how: str) -> None:
        nonlocal current
        placed[page] = (*found, how)
        copies.add(texts[page])
        seen[:] = tracker.advance(seen, page, found[1], tracker.CONFIRMED)
        scores[:] = [*scores, found[2]][-MEMORY:]
        current = next((k for k, c in enumerate(real) if c[1] <= found[0] < c[2]), current)

    for page, words in pages:
        if len(words.strip()) < LEAST_PAGE:
            skipped.add(page)
            continue
        since += 1
        if since >= REANCHOR and seen:
            since = 0
            found = book.find(words, body, len(text), NEAR_BY)
            if found and far(found, page):
                seen[:] = [(page - 1, found[0])]
        if copies.holds(words):
            skipped.add(page)
            continue
        named = chapter_named(heading(words), [c[0] for c in real], current) if real else None
        if named is not None and named >= current - 2:
            current = named
            found = book.find(words, real[named][1], real[named][2], BY_CHAPTER)
            if found:
                note(page, found, "chapter")
                continue
        low, high = tracker.window(seen, page, len(text))
        found = book.find(words, max(low, body) if not seen else low, high, NEAR_BY)
        if not found:
            continue
        paced = not seen or consistent(seen[-1][1], seen[-1][0], found[0], page, tracker.pace(seen))
        if not paced or regressed(found[2], scores):
            whole = book.find(words, body, len(text), NEAR_BY)
            if not whole:
                continue
            if far(whole, page):
                found, seen[:] = whole, []
        note(page, found, "near")
    order = [p for p, _ in pages]
    for _ in range(ROUNDS):
        fresh = {}
        for k, page in enumerate(order):
            if page in placed or page in skipped:
                continue
            before = next((placed[p] for p in reversed(order[:k]) if p in placed), None)
            after = next((placed[p] for p in order[k + 1 :] if p in placed), None)
            if not before and not after:
                continue
            low = max(0, before[1] - MARGIN) if before else max(0, after[0] + MARGIN - REACH)
            high = min(len(text), after[0] + MARGIN if after else low + REACH)
            found = book.find(texts[page], low, high, REPAIRED)
            if found:
                placed[page] = fresh[page] = (*found, "repair")
        if not fresh:
            break
    return placed


def align_in_order(pages: DataFrame, books: DataFrame, chapters: DataFrame | None = None, book: str = "conv_id", page: str = "turn", text: str = "text") -> DataFrame:
    """(book, scan_page, pg_start, pg_end, confidence, found_by) of pages in their book's text, one book a task.

    books has (book, book_text), chapters (book, title, start, end). Null texts are
    empty; of rows that repeat a page the least text counts.
    """
    own = pages.groupBy(book, page).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    heads = books.select(F.col(book).alias("__book"), "book_text")
    if chapters is None:
        heads = heads.withColumn("heads", F.array().cast("array<struct<start:long,end:long,title:string>>"))
    else:
        listed = chapters.groupBy(F.col(book).alias("__book")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "title"))).alias("heads"))
        heads = heads.join(listed, "__book", "left")
    heads = heads.withColumn("body", anchors.body_start(F.col("book_text")))

    def fold(own: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        columns = [book, "scan_page", "pg_start", "pg_end", "confidence", "found_by"]
        if not len(base) or not len(own) or base["book_text"].iloc[0] is None:
            return pd.DataFrame({c: [] for c in columns}).astype({book: "int64", "scan_page": "int64", "pg_start": "int64", "pg_end": "int64", "confidence": "float64", "found_by": "str"})
        marks = base["heads"].iloc[0]
        named = [(x["title"], x["start"], x["end"]) for x in (marks if marks is not None else [])]
        rows = [(int(p), t) for p, t in own.sort_values(page)[[page, "t"]].itertuples(index=False)]
        found = place(base["book_text"].iloc[0], rows, named, int(base["body"].iloc[0]))
        return pd.DataFrame([(own[book].iloc[0], p, *x) for p, x in sorted(found.items())], columns=columns)

    return dealt(own, book).groupBy(book).cogroup(dealt(heads, "__book").groupBy("__book")).applyInPandas(fold, f"{book} long, scan_page long, pg_start long, pg_end long, confidence double, found_by string")

import random

import pytest
from pyspark.sql import functions as F

from tests.test_plans import book
from variorum.operators import diff, stitched
from variorum.plans import errata


def editions(seed, n_pages=8, wrong=6):
    """A book's text, its pages cut anywhere with words parted at their ends, alignments that are some words off, and the words changed."""
    rng = random.Random(seed)
    words = " ".join(book(seed, 90)).split()
    per = len(words) // n_pages
    scan, changed = list(words), {}
    for k in rng.sample(range(20, len(words) - 20), wrong):
        if len(words[k]) > 5:
            scan[k] = words[k][:-3] + "qqx"
            changed[scan[k]] = min(k // per, n_pages - 1)
    body, starts = " ".join(words), []
    at = 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    pages, found = [], []
    for p in range(n_pages):
        own = scan[p * per : (p + 1) * per if p < n_pages - 1 else None]
        if p < n_pages - 1 and len(own[-1]) > 6 and own[-1] not in changed:
            tail = own[-1]
            own = [*own[:-1], tail[:3] + "-"]
            scan[(p + 1) * per] = tail[3:] + " " + scan[(p + 1) * per]
        pages.append((1, p, " ".join(own)))
        a, b = p * per, min(len(words) - 1, (p + 1) * per)
        jitter = rng.randint(-6, 6) if 0 < p < n_pages - 1 else 0
        found.append((1, p, max(0, starts[a] + jitter), min(len(body), starts[b] + jitter + 8)))
    return body, pages, found, changed


def frames(spark, body, pages, found):
    books = spark.createDataFrame([(1, body)], "book_id long, body_text string")
    own = spark.createDataFrame(pages, "book_id long, page_num long, text string")
    aligned = spark.createDataFrame(found, "book_id long, scan_page long, pg_start long, pg_end long")
    return books, aligned, own


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_stitched_differences_stand_on_their_pages_and_are_fewest(spark, seed):
    body, pages, found, changed = editions(seed)
    books, aligned, own = frames(spark, body, pages, found)
    got = stitched.candidates(books, aligned, own).collect()
    told = {r.scan_text: r.scan_page for r in got}
    for word, page in changed.items():
        hit = [p for t, p in told.items() if word in t.split()]
        assert hit == [page]
    pairs = aligned.join(own.withColumnRenamed("page_num", "scan_page"), ["book_id", "scan_page"]).withColumn("passage", F.lit(body).substr(F.col("pg_start") + 1, F.col("pg_end") - F.col("pg_start")))
    n = {m: diff.candidates(diff.hunks(pairs, ["book_id", "scan_page"], "passage", "text", m)).count() for m in ("flat", "recursive")}
    assert min(n.values()) > len(got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gaps_and_pages_by_brute_force(seed):
    """Each difference stands between two anchors, on the page of its place; what is outside of gaps is equal."""
    rng = random.Random(seed)
    a = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    b, pages_of = [], []
    for k, w in enumerate(a):
        if rng.random() < 0.03:
            w = f"x{rng.randint(0, 3)}"
        if rng.random() < 0.97:
            b.append(w)
            pages_of.append(k // 40)
    gaps = stitched.gaps_between(a, b)
    i = j = 0
    for i1, i2, j1, j2 in gaps:
        assert a[i:i1] == b[j:j1]
        i, j = i2, j2
    assert a[i:] == b[j:]
    for h in stitched.stitched_hunks(a, b, pages_of):
        inside = next(g for n, g in enumerate(gaps) if n == h["gap"])
        assert inside[0] <= h["i1"] <= inside[1] and inside[2] <= h["j1"] <= inside[3]
        if h["tag"] == "extra":
            assert h["page"] == pages_of[h["j1"]]
        elif h["b_text"]:
            assert h["places"] == [pages_of[k] for k in range(inside[2], inside[3]) if b[k] == h["b_text"].split()[0]]
    assert stitched.stitched_hunks(a[:8], ["y"] * 8, [0] * 8) is None


def test_the_nth_of_equal_words_has_the_nth_page(spark):
    lead, mid, end = ([f"{c}{k}" for k in range(12)] for c in "abc")
    body = [*lead, "alpha", "beta", "gamma", "delta", *mid, *end]
    pages = [(1, 0, " ".join([*lead, "zzzzzz", "beta"])), (1, 1, " ".join(["zzzzzz", "delta", *mid, *end]))]
    text = " ".join(body)
    cut = text.index("gamma")
    books, aligned, own = frames(spark, text, pages, [(1, 0, 0, cut), (1, 1, cut, len(text))])
    got = stitched.candidates(books, aligned, own).orderBy("seq").collect()
    assert [(r.pg_text, r.scan_text, r.scan_page) for r in got] == [("alpha", "zzzzzz", 0), ("gamma", "zzzzzz", 1)]


def test_segments_with_few_anchors_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten"
    books, aligned, own = frames(spark, text, [(1, 0, "one two thrxx four fixx six sevxx eight nixx ten")], [(1, 0, 0, len(text))])
    got = stitched.candidates(books, aligned, own).collect()
    assert [(r.pg_text, r.whole, r.scan_page) for r in sorted(got, key=lambda r: r.seq)] == [("three", False, 0), ("seven", False, 0)] or all(not r.whole for r in got)
    assert stitched.candidates(books, aligned.filter("false"), own).count() == 0
    assert stitched.candidates(books, aligned, own.filter("false")).count() == 0
    assert stitched.over_page_ends(["some-", "thing", "else"], [0, 1, 1]) == (["something", "else"], [0, 1])


def test_errata_plan_stitches(spark):
    body, pages, _, changed = editions(7)
    books, _, own = frames(spark, body, pages, [(1, 0, 0, 1)])
    got = errata.run(books, own, mode="stitched").errors.collect()
    norm = " ".join(body.split())
    for word, page in changed.items():
        rows = [r for r in got if word in r.scan_text.split()]
        assert rows and rows[0].scan_page == page
        assert all(norm[r.pg_offset : r.pg_offset + len(r.pg_text)] == r.pg_text for r in rows)

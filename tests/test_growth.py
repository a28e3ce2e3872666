"""Work of queries that must not grow faster than their tables, or be repeated."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from variorum import queries
from variorum.functions import runs
from variorum.operators import anchors, diff, editions, gaps, pairs, sequential

DATA = "/root/testdata/sf0.001"


def test_body_start_splits_and_marks_a_text_once(spark):
    """each use of the marked paragraphs was a copy of the whole expression, one of them in a loop."""
    text = F.concat(F.col("id").cast("string"), F.lit("x"))
    plan = spark.range(1).select(anchors.body_start(text).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(") == 1 and plan.count("margin-") == 1


def test_body_start_by_its_rules(spark):
    """the first prose after a heading, within 50 paragraphs, else the first long paragraph."""
    prose, long = "Aa bb. " * 30, "Aa bb. Cc? " * 60
    texts = {
        f"front {prose}\n\nCHAPTER I\n\n{prose}": 0, "Part two": 0, "": 0, None: 0, f"short\n\n \t\n\nCHAPTER I\n\n{prose}": len("short") + len("CHAPTER I") + 4,
        f"{{x}} CHAPTER I {prose}\n\n{prose}": len(f"{{x}} CHAPTER I {prose}".strip()) + 2, f"{long}\n\nCHAPTER I\n\n" + "x\n\n" * 49 + prose: 0, f"a\n\n{long}\n\nCHAPTER I\n\n" + "x\n\n" * 48 + prose: 1 + len(long.strip()) + len("CHAPTER I") + 6 + 48 * 3,
    }
    texts[next(iter(texts))] = len(f"front {prose}".strip()) + len("CHAPTER I") + 4
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", anchors.body_start(F.col("t")).alias("s")).collect()}
    assert got == texts


@pytest.mark.parametrize("name", ["coverage_gaps", "gap_report", "sequential_align"])
def test_books_are_dealt_out_whatever_their_bytes(spark, name):
    """small partitions of books, which take long, were joined to one task."""
    found = queries.QUERIES[name](spark, DATA) if name != "gap_report" else gaps.all_gaps(*_covered(spark))
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def _covered(spark):
    own = spark.createDataFrame([(k, 1, f"page {k} of a book in few words") for k in range(8)], "conv_id long, turn long, page_text string")
    al = own.selectExpr("conv_id", "turn as scan_page", "0L as pg_start", "5L as pg_end", "0.9D as confidence")
    return own, al, own.selectExpr("conv_id", "page_text as book_text")


def test_runs_are_those_of_difflib():
    """Ties go to the first run in a, then in b, of characters as of words."""
    rng = random.Random(1)
    for _ in range(3000):
        letters = rng.choice(["ab", "abc ", "abcdefghij klmnop"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(2))
        b = rng.choice([b, a[: rng.randint(0, len(a))] + b[:5] + a[rng.randint(0, len(a)) :]])
        want = SequenceMatcher(None, a, b, autojunk=False)
        assert runs.ratio(a, b) == runs.ratio(list(a), list(b)) == want.ratio()
        assert runs.blocks(list(a), list(b)) == [tuple(m) for m in want.get_matching_blocks()]
        assert runs.opcodes(list(a), list(b)) == want.get_opcodes()


def test_pairs_are_dealt_out_whatever_their_bytes(spark):
    """Few bytes of pairs, which take long, were joined to one task."""
    texts = spark.createDataFrame([(k, "some words", "some other words") for k in range(9)], "k long, a_text string, b_text string")
    assert diff.hunks(texts, ["k"]).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_copies_of_placed_pages_are_those_of_difflib():
    """likeness is only computed where lengths and letters allow a copy."""
    rng, pages = random.Random(2), []
    for k in range(120):
        own = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 90)))
        if k % 3 and pages:
            own = list(rng.choice(pages))
            for _ in range(rng.randint(0, 8)):
                own.insert(rng.randint(0, len(own)), rng.choice("xyz"))
        pages.append("".join(own))
    placed, held = sequential.Copies(), 0
    for k, own in enumerate(pages):
        want = any(SequenceMatcher(None, own, x).quick_ratio() > sequential.COPY and SequenceMatcher(None, own, x).ratio() > sequential.COPY for x in pages[:k])
        assert placed.holds(own) == want
        placed.add(own)
        held += want
    assert 10 < held < 110


def test_dictionary_lookup_reads_the_texts_once(spark):
    """the distinct words, used four times, were split out of all texts for each use."""
    found = queries.QUERIES["dictionary_lookup"](spark, DATA)
    assert found.count() > 100 and {x.split("/")[-1] for x in found.inputFiles()} <= {"benchmark.parquet"}


def test_a_class_is_sketched_once_a_task():
    """of equal sets only the first has bands, so that copies don't travel by band."""
    words = pa.array([list(range(9)), list(range(9)), [1, 2], list(range(1, 9))], pa.list_(pa.int64()))
    got = list(pairs._sketcher(5)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), words], names=["doc_id", "w"])])))[0]
    assert [len(x) for x in got.column("bands").to_pylist()] == [pairs.BANDS, 0, 0, pairs.BANDS] and got.column("cls")[0] == got.column("cls")[1]


@pytest.mark.parametrize("bits", [0, 1 << 26])
def test_candidates_are_confirmed_in_blocks(spark, monkeypatch, bits):
    """a set travels once to each pair of blocks with candidates of it."""
    monkeypatch.setattr(pairs, "BLOCK", 8)
    monkeypatch.setattr(pairs, "BITS", bits)
    rng = random.Random(4)
    sets = {k: np.array(sorted(rng.sample(range(60), rng.randint(20, 50))), np.uint64) for k in range(-20, 20)}
    met = [(a, b) for a in sets for b in sets if a < b and rng.random() < 0.5]
    frame = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "cls long, s binary")
    got = pairs._confirmed(spark.createDataFrame(met, "u long, v long"), frame).collect()
    want = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in met}
    assert len(got) == len(met) and {(r.u, r.v): r.jaccard for r in got} == want


def _group(n):
    """Texts of some words of their own and a line that all share, each with a near copy: few are alike, all are candidates of many."""
    rng = random.Random(9)
    line = " ".join(f"common{i}" for i in range(18))
    for k in range(n // 2):
        own = [f"w{rng.randint(0, 10**9)}" for _ in range(14)]
        yield 2 * k, f"{' '.join(own)}\n{line}"
        yield 2 * k + 1, f"{' '.join(own[:-1])} x{k}\n{line}"


@pytest.mark.parametrize("found", [pairs.nearest_pairs, pairs.linked_classes])
def test_a_shared_line_makes_no_square_of_rows(spark, found):
    """the candidates of a group, nearly all unlike, were listed as rows and shuffled."""
    def shuffled():
        return spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    def written(n):
        docs = spark.createDataFrame(list(_group(n)), "doc_id long, text string")
        start = shuffled()
        got = found(docs).select("a_id", "b_id").collect()
        time.sleep(1)  # the listener is behind by a little
        assert sorted((r.a_id, r.b_id) for r in got) == [(2 * k, 2 * k + 1) for k in range(n // 2)]
        return shuffled() - start

    small, large = written(1000), written(2000)
    assert large < 2.5 * small


@pytest.mark.parametrize("side", [1, 3, 2048])
def test_links_by_blocks_are_those_of_all_pairs(spark, monkeypatch, side):
    """sets meet in blocks, of which a group has more than the 64 bits that tell them."""
    monkeypatch.setattr(pairs, "SIDE", side)
    rng, texts = random.Random(6), []
    base = [f"w{k}" for k in range(60)]
    for k in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(60)] = f"E{rng.randint(0, 400)}"
        texts.append(" ".join(own[: rng.randint(30, 60)]))
    ids = [f"d{k:03}" for k in range(150)]
    rng.shuffle(ids)
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for d, w in zip(ids, (t.split() for t in texts), strict=True)}
    first = {s: min(d for d, x in sets.items() if x == s) for s in sets.values()}
    own = {d: s for s, d in first.items()}
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b and 2 * len(own[a] & own[b]) > len(own[a] | own[b])}
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string")
    got = pairs.linked_classes(docs).filter("jaccard < 1").collect()
    assert len(want) > 1000 and {(r.a_id, r.b_id): r.jaccard for r in got} == want and len(got) == len(want)
    best = {b: min((-want[x, y], x) for x, y in want if y == b) for _, b in want}
    near = pairs.nearest_pairs(docs).collect()
    assert {r.b_id: (-r.jaccard, r.a_id) for r in near} == best and len(near) == len(best)
    assert all((r.a_text, r.b_text) == tuple(min(t for d, t in zip(ids, texts, strict=True) if d == x) for x in (r.a_id, r.b_id)) for r in near)


def test_candidates_hold_all_alike_sets(monkeypatch):
    """sets above a share meet in their rarest values, however many are listed at once."""
    rng = random.Random(7)
    for least in (0.3, 0.5, 0.7):
        for listed, times in ((1, 16), (1 << 22, 16), (1 << 22, 0)):
            monkeypatch.setattr(pairs, "LISTED", listed)
            monkeypatch.setattr(pairs, "TIMES", times)
            sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 35))), np.uint64) for _ in range(60)]
            got = [tuple(p) for p in pairs._candidates(sets, least).tolist()]
            want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) > least}
            assert want <= set(got) and len(set(got)) == len(got) and all(i < j for i, j in got)


def test_bands_that_several_have_are_marked(spark):
    """each band was sent whole with its class, of which few have another one."""
    rng = random.Random(3)
    bands = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(50)] for _ in range(200)]
    for k in range(0, 200, 20):
        bands[k + 1][:9] = bands[k][:9]
    frame = spark.createDataFrame([(k, 9, b) for k, b in enumerate(bands)] + [(-1, 9, [])], "cls long, n long, bands array<long>").repartition(5)
    got = {(r.cls, r.band) for r in pairs._entries(frame).collect()}
    want = {(k + i, b) for k in range(0, 200, 20) for b in bands[k][:9] for i in (0, 1)}
    assert want <= got and len(got) < len(want) + 20


def test_line_widths_travel_without_their_lines(spark):
    """lines were sent whole to be numbered, of which only the widths count."""
    docs = spark.range(3).selectExpr("id AS doc_id", "repeat(concat(repeat('word ', 12), '\\n'), 5) AS text")
    plan = editions.line_profile(docs)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window [row_number"):]
    assert "width" in window and [(r.modal, r.lines) for r in editions.line_profile(docs).collect()] == [(60, 5)] * 3

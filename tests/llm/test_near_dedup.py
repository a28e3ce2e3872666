import random

import numpy as np
import pytest

import corpus_pipeline
from variorum.llm import near_dedup as N
from variorum.llm.components import components
from variorum.llm.words import seeds, shingle_sets

import pyarrow as pa


def brute(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def texts(rng, groups, members, words=40, edits=4):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(words)] = f"e{rng.randint(0, 4000)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_components_are_those_of_all_pairs(spark, k):
    rng = random.Random(k)
    own = [*texts(rng, 12, 8), *texts(rng, 3, 25, 60, 9), "", None, "one", "ONE", "a b", "A  b\n", "x y z", " \t"]
    rng.shuffle(own)
    rows = list(enumerate(own))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, rep int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, shingle_words=k).collect()}
    assert got == brute(rows, k, 4, 5)
    kept = N.near_duplicates(df, shingle_words=k).filter("kept").collect()
    assert {r.doc_id for r in kept} == {c for _, c in got.values()}


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert N.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_sketches_estimate_similarity_and_fill_every_bin():
    rng = np.random.default_rng(0)
    salts = seeds(2 * 256, 3)
    for n in (1, 2, 7, 100, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sketch = N.fast_sketch(a, 256, salts)
        assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert (sketch == N.fast_sketch(a[::-1].copy(), 256, salts)).all()
    shared, only = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = np.concatenate([shared, only[:200]]), np.concatenate([shared, only[200:]])
    assert abs((N.fast_sketch(a, 256, salts) == N.fast_sketch(b, 256, salts)).mean() - 800 / 1200) < 0.1


def test_blocks_find_links_between_components():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    far = np.sort(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    rows = [(1, 1, False, base), (2, 2, False, base[:90]), (3, 3, False, far), (2, 2, True, base[:90])]
    assert list(N._block_links(rows, 4, 5)) == [(2, 1)]


@pytest.mark.parametrize("task_links", [1 << 18, 20])
def test_chains_are_one_component(spark, task_links):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "u long, v long")
    got = sorted((r.node, r.component) for r in components(links, task_links).collect())
    assert got == sorted({**dict.fromkeys(range(61), 0), 100: 100, 101: 100}.items())
    assert components(links.filter("false")).count() == 0


def test_a_large_family_of_near_copies(spark):
    """A thousand near copies of one text, far more than a block holds, of which not all are near one another."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 2000)}" for _ in range(100)]
    own = [" ".join(f"e{rng.randint(0, 99999)}" if rng.random() < 0.01 + k % 5 * 0.012 else w for w in base) for k in range(1000)]
    rows = list(enumerate([*own, *["the same words every time"] * 40]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = N.near_duplicates(df, shingle_words=2).collect()
    sets = np.zeros((1000, len(names := {x: n for n, x in enumerate(sorted({p for t in own for p in zip(t.split(), t.split()[1:])}))})), np.float32)
    for k, t in enumerate(own):
        sets[k, [names[p] for p in zip(t.split(), t.split()[1:])]] = 1
    both, size = sets @ sets.T, sets.sum(1)
    near = 5 * both >= 4 * (size[:, None] + size[None, :] - both)
    label = np.arange(1000)
    while (now := np.where(near, label[None, :], 1000).min(1)).tolist() != label.tolist():
        label = now
    assert len(set(label.tolist())) > 50 and np.bincount(label).max() > 500
    assert {r.doc_id: r.component_id for r in found} == {**dict(enumerate(label.tolist())), **dict.fromkeys(range(1000, 1040), 1000)}


def test_words_are_split_at_ascii_white_space_alone():
    sets = list(shingle_sets(pa.array(["a b c", "A b C", None, "", "É x", "é x"]), 2))
    assert [s.size for s in sets] == [1, 1, 0, 0, 1, 1]
    assert (sets[0] == sets[1]).all() and sets[4][0] != sets[5][0]


def test_pipeline_keeps_one_of_each_where_ids_repeat(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"{x}{rng.randint(0, 400)}" for _ in range(40)) for x in "abc")
    near = [(1, a), (2, a + " z"), (2, b), (3, c), (3, c), (4, b), (5, c + " z"), (6, None), (6, None), (6, ""), (7, a), (7, a + " y"), (None, a)]
    rows = [(i, t, k % 2) for k, (i, t) in enumerate(near)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect())
    assert got == sorted([(1, a), (2, b), (3, c), (6, ""), (6, ""), (0, a)])
    got = [r.doc_id or 0 for r in corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame([(1, a, 0), (2, a + " z", 0), (3, c, 0), (4, c, 0), (5, b, 0)], df.schema), "").collect()]
    assert sorted(got) == [1, 3, 5]


def test_pipeline_keeps_either_text_of_the_same_id_and_component_once(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(5, text), (5, text + " z"), (9, "other words than those of the rest")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect()) == [5, 9]

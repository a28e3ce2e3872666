import hashlib
import random
from collections import Counter

from variorum.llm import fingerprint as P


def true_likeness(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def test_edited_texts_and_neighbours(spark):
    rng = random.Random(3)
    ids = [5, 6, 7, 1030, 4000, -20, 9000, 9001]
    texts = {i: " ".join(f"w{rng.randint(0, 60)}é" for _ in range(rng.randint(30, 200))) for i in ids}
    texts[6] = texts[5]
    texts[7] = ""
    df = spark.createDataFrame([(i, t or None, "x", 1) for i, t in texts.items()], "doc_id long, text string, span string, end int")
    got = {r.doc_id: r for r in P.edit_likeness(df, samples=120).collect()}
    order = sorted(ids, reverse=True)
    assert set(got) == set(ids)
    for i, k in enumerate(order):
        t, nxt = texts[k], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if t and nxt:
            assert abs(got[k].near_edited - true_likeness(t, edited)) < 0.2
            assert abs(got[k].near_next - true_likeness(t, nxt)) < 0.2
    assert got[5].fingerprint == got[6].fingerprint and got[6].near_next == 1.0
    assert got[7].fingerprint == "" and got[7].near_edited == 1.0 and got[7].near_next == 0.0


def test_samples_estimate_weighted_similarity(spark):
    rng = random.Random(8)
    rows = []
    for k in range(40):
        a = [f"w{rng.randint(0, 30)}" for _ in range(120)]
        cut = rng.randint(0, 120)
        rows.append((k, " ".join(a), " ".join(a[:cut] + [f"x{rng.randint(0, 30)}" for _ in range(120 - cut)])))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    one, two = P.signatures(df, ["k"], "a", 128), P.signatures(df, ["k"], "b", 128)
    got = one.withColumnRenamed("signature", "a").join(two.withColumnRenamed("signature", "b"), "k").select("k", P.likeness("a", "b", 128).alias("n")).collect()
    errors = [r.n - true_likeness(*rows[r.k][1:]) for r in got]
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.17


def test_fingerprints_nulls_and_repeats(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "A  b"), (3, " \n")]
    got = sorted((r.doc_id or -1, r.fingerprint) for r in P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [x for x, _ in got] == [-1, 1, 1, 2, 3] and got[0][1] == got[1][1] == got[2][1] and got[3][1] == got[4][1] == ""
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert P.edit_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ties_and_null_ids_have_an_order(spark):
    rows = [(1, "b"), (1, "a"), (None, "z"), (2, "c")]
    got = P.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").filter("not end").collect()
    assert {(r.id, r.text): r.next_text for r in got} == {(2, "c"): "a", (1, "a"): "b", (1, "b"): "z", (None, "z"): "c"}


def test_spans_are_put_in_order_by_parts(spark):
    rng = random.Random(2)
    spans = sorted({rng.randint(-(1 << 53), 1 << 53) for _ in range(40)} | set(range(-3, 30)) | {5000, 5001, -(1 << 62)})
    df = spark.createDataFrame([(x,) for x in spans], "span long")
    want = {x: spans[k - 1] for k, x in enumerate(spans)}
    for one_task in (1000, 3):
        assert {r.span: r.before for r in P._before(df, one_task).collect()} == want
    rows = [(x << 10 | k, f"{x} {k}") for x in spans[1:] for k in (1, 7)]
    got = P.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", one_task=3).filter("not end").collect()
    rows.sort(reverse=True)
    assert {r.id: r.next_text for r in got} == {a[0]: b[1] for a, b in zip(rows, rows[1:] + rows[:1])}

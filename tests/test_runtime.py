import pytest

from variorum.operators import pages
from variorum.runtime import is_local


@pytest.mark.parametrize(("master", "local"), [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://h:7077", False)])
def test_temporary_folders_are_for_local_masters(master, local):
    assert is_local(master) == local


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_are_those_of_all_pairs(spark, seed):
    import random

    rng = random.Random(seed)

    def spans(n):
        out = []
        for k in range(n):
            at = rng.randint(0, 30000)
            out.append((k % 3, k, at, at + rng.choice([0, 1, 50, 4096, 9000])))
        return out

    a, b = spans(25), spans(25)
    x = spark.createDataFrame(a, "book long, i long, s long, e long")
    y = spark.createDataFrame(b, "book long, j long, low long, high long")
    got = sorted((r.i, r.j) for r in pages.overlapping(x, y, "book", ("s", "e"), ("low", "high")).collect())
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3] and q[2] < q[3])
    assert got == want

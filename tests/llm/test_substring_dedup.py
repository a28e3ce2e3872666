import random

import pytest

from variorum.llm.substring_dedup import SuffixAutomaton, remove_repeats


def brute(rows, window):
    first = {}
    for i, words in sorted(rows, key=lambda x: x[0]):
        for j in range(len(words) - window + 1):
            first.setdefault(tuple(words[j : j + window]), i)
    out = []
    for i, words in rows:
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            if first[tuple(words[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out)


def test_automaton_tells_the_first_document_of_each_run():
    rng = random.Random(2)
    for _ in range(200):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 6))]
        automaton = SuffixAutomaton()
        for d, s in enumerate(seqs):
            automaton.add(s, d)
        for s in [*seqs, [rng.randint(0, 3) for _ in range(12)]]:
            for n in (1, 3, 5):
                for i, got in enumerate(automaton.matches(s, n)):
                    run = s[i + 1 - n : i + 1] if i + 1 >= n else None
                    want = next((d for d, q in enumerate(seqs) if run and any(q[j : j + n] == run for j in range(len(q) - n + 1))), -1)
                    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words_removed_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}{i % 7}" for i in range(rng.randint(12, 40))] for k in range(4)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(passages)
            a = rng.randrange(len(part))
            words += rng.choice([[f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 20))], part, part[a:], part[:a]])
        rows.append((i * 3 - 30, words))
    rows += [(500, ["same"] * 40), (501, ["same"] * 30), (502, [])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, " \n".join(w), 7) for i, w in rows], "doc_id long, text string, grp int")
    for hot_runs in (1000, 2):
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in remove_repeats(df, hot_runs=hot_runs).collect())
        assert got == brute(rows, 13)


def test_a_common_run_in_many_contexts_and_a_very_long_text(spark):
    """An eight-word run in 1500 contexts, a passage that many share, and a text of 30000 words that has both."""
    rng = random.Random(9)
    run, passage = [f"r{i}" for i in range(8)], [f"p{i}" for i in range(30)]
    rows = []
    for i in range(1500):
        around = [f"w{rng.randint(0, 3)}" for _ in range(16)]
        rows.append((i, around[:8] + run + around[8:] + (passage if i % 3 == 0 else [])))
    rows.append((5000, [f"x{k}" for k in range(15000)] + run + passage + [f"x{k}" for k in range(15000)]))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in remove_repeats(df).collect())
    assert got == brute(rows, 13)


def test_nulls_empty_tables_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(15))
    rows = [(1, None), (2, long), (2, long), (None, long), (3, long)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 15, 0), (1, 0, 0), (2, 15, 0), (2, 15, 0), (3, 15, 15)]

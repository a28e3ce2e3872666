import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from variorum.llm import packing as P
from variorum.llm.queries import tokenizer_path


def test_first_fit_is_the_first_bin_with_room():
    rng = random.Random(1)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        tree, rooms = P.Bins(len(sizes), 100), []
        for n in sizes:
            want = next((k for k, r in enumerate(rooms) if r >= n), len(rooms))
            if want == len(rooms):
                rooms.append(100)
            rooms[want] -= n
            assert tree.first_fit(n) == want


def test_pieces_cover_documents_and_fill_sequences():
    rng = random.Random(4)
    for n in (1, 3, 200, 2000):
        lengths = [rng.choice((1, rng.randint(1, 50), rng.randint(1, 2048), rng.randint(1, 9000))) for _ in range(n)]
        pieces = P.pack_lengths(lengths, 2048)
        for d, size in enumerate(lengths):
            at = 0
            for _, s, k, _, _ in sorted(p for p in pieces if p[0] == d):
                assert s == at and k > 0
                at += k
            assert at == size
        bins = {}
        for _, _, k, b, o in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert bins.get(b, 0) == o
            bins[b] = o + k
        assert max(bins.values()) <= 2048 and sorted(bins) == list(range(len(bins)))
        if n >= 200:
            assert sum(2048 - v for v in bins.values()) < 0.03 * sum(lengths)


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(9)
    alphabet = [*" \t\n\x0b\x1f aAbéΣİß9'’.,!你😀́", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "Word ", "the "]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))) for k in range(300)] + [(300, None), (301, ""), (302, "the house of " * 3000)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, grp int, ids string")
    pieces = P.pack(df, tokenizer_path(), group_docs=50).withColumn("crc", F.crc32("ids")).collect()
    by = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(bytes(p.ids)) == p.crc
        assert len(by.setdefault(p.doc_id, [])) == p.start
        by[p.doc_id] += ids.tolist()
    for k, t in rows:
        assert by[k] == encoder.encode(t or "", add_special_tokens=False).ids + [1]
    assert all(p.doc_tokens == len(by[p.doc_id]) for p in pieces)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("rows", [[(1, "a"), (1, "a"), (None, "b"), (None, None)]])
def test_repeated_rows_and_null_ids_are_packed_each(spark, rows):
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    assert sorted((p.doc_id or -1, p.length) for p in got) == [(-1, 1), (-1, 2), (1, 2), (1, 2)]


def test_rows_of_one_id_are_dealt_to_all_groups(spark):
    df = spark.createDataFrame([(7, "the same words")] * 400 + [(None, "the same words")] * 400, "doc_id long, text string")
    got = P.pack(df, tokenizer_path(), group_docs=50).collect()
    groups = [p.sequence_id >> 32 for p in got]
    assert len(got) == 800 and len(set(groups)) == 16 and max(groups.count(g) for g in set(groups)) < 100

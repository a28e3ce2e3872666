import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from variorum.operators import locate, verifier


def verdict(text, read):
    a, b = text.strip(), read.strip()
    if not b or a.lower() == b.lower():
        return "pg_correct", 0.95, ""
    if a.split() == b.split():
        return "pg_correct", 0.9, ""
    r = difflib.SequenceMatcher(None, a, b).ratio()
    return ("scan_correct", 0.9, b) if r >= 0.8 else ("edition_variant", 0.8, b) if r >= 0.6 else ("ambiguous", 0.5, b)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_of_batches(spark, seed):
    rng = random.Random(seed)
    items, replies, want = [], [], {}
    for batch in range(14):
        answers = []
        for k in range(rng.randint(1, 6)):
            text = " ".join(rng.choice(["house", "river", "a", "mountain"]) for _ in range(rng.randint(1, 6)))
            read = rng.choice([text, text.upper(), text.replace(" ", "  "), text.replace("o", "0"), "".join(rng.sample(text, len(text))), "", text[::-1]])
            unable = rng.random() < 0.1
            items.append((batch, k, text, "x"))
            fate = rng.choice(["said", "said", "said", "missing", "twice"])
            if fate == "twice":
                answers.append({"index": k, "transcription": "something else", "image_evidence": "first", "unable_to_verify": False})
            if fate != "missing":
                answers.append({"index": k, "transcription": read, "image_evidence": f"near {k}", "unable_to_verify": unable})
            want[batch, k] = ("unable_to_verify", 0.0, "") if fate == "missing" or unable or not read else verdict(text, read)
        said, form = json.dumps(answers), rng.choice(["plain", "fence", "prose", "broken", "null", "object", "none"])
        reply = {"plain": f" {said}\n", "fence": f"Sure.\n```json\n{said}\n```", "prose": f"The answers: {said} as seen.", "broken": said[:-2], "null": None, "object": json.dumps({"index": 0})}.get(form)
        if form != "none":
            replies.append((batch, reply))
        if form in ("broken", "null", "object", "none") or not answers:
            want |= {x: ("unable_to_verify", 0.0, "") for x in want if x[0] == batch}
    df = spark.createDataFrame(items, "batch_id long, item long, pg_text string, verdict_note string")
    got = verifier.batch_verdicts(df, spark.createDataFrame(replies, "batch_id long, reply string")).collect()
    assert {(r.batch_id, r.item): (r.verdict, r.confidence, r.suggested_fix) for r in got} == want and len(got) == len(items)


def test_single_answers_and_requests(spark):
    rows = [(1, "the house", '{"transcription": "the hovse", "image_evidence": "by the hovse", "unable_to_verify": false}'), (2, "the house", 'Well: ```json\n{"transcription": "THE HOUSE"}\n```'), (3, "x", "no JSON"), (4, "y", None), (5, "the house", 'I read {"transcription": "the  house", "unable_to_verify": false} here'), (6, "z", '{"unable_to_verify": true}')]
    got = {r.id: r for r in verifier.single_verdicts(spark.createDataFrame(rows, "id long, pg_text string, reply string")).collect()}
    assert [got[k].verdict for k in range(1, 7)] == ["scan_correct", "pg_correct", "unable_to_verify", "unable_to_verify", "pg_correct", "unable_to_verify"]
    assert got[1].reasoning == "Scan transcription differs from PG text (89% similar)." and got[1].image_evidence == "by the hovse" and got[4].reasoning == "Empty API response"
    items = spark.createDataFrame([(1, k, f"passage {k}" if k else "ab", "around") for k in range(45)], "batch_id long, item long, pg_text string, context string")
    asked = sorted((r.part, r.n_items, r.request) for r in verifier.batch_requests(items).collect())
    assert [x[:2] for x in asked] == [(0, 20), (1, 20), (2, 5)] and "Item 44: passage 44" in asked[2][2] and asked[0][2].count("Too short") == 1
    assert "too short" in items.select(verifier.request(F.col("pg_text"), F.col("context")).alias("q")).first().q


def reference_line(lines, text):
    """The definition, step by step: a line, then two to six lines, then words alike."""
    clean = [" ".join(re.sub(r"<[^>]+>", " ", x).replace("&rsquo;", "'").replace("&amp;", "&").split()) for x in lines]
    for n, x in enumerate(clean, 1):
        if text in x:
            return n
    for size in range(2, 7):
        for n in range(1, len(clean) - size + 2):
            if text in " ".join(x for x in clean[n - 1 : n - 1 + size] if x):
                return n
    words = text.lower().split()
    if 0 < len(words) <= 5:
        for n, x in enumerate(clean, 1):
            own = x.lower().split()
            for i in range(len(own) - len(words) + 1):
                if sum(a in b or b in a for a, b in zip(words, own[i:])) >= len(words) * 0.8:
                    return n
    return 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_of_passages(spark, seed):
    rng = random.Random(seed)
    files, asked = [], []
    for book in range(6):
        lines = [rng.choice(["", "<p>", " ".join(rng.choice(["house", "it&rsquo;s", "<i>river</i>", "a", "stone", "tree"]) for _ in range(rng.randint(1, 6)))]) for _ in range(rng.randint(0, 25))]
        files.append((book, "\n".join(lines)))
        for k in range(12):
            asked.append((book, k, " ".join(rng.choice(["house", "it’s", "river", "a", "stone", "tree", "stones", "sea"]) for _ in range(rng.randint(1, 7)))))
    asked += [(99, 0, "no file"), (0, 50, None), (0, 51, "  ")]
    got = locate.with_lines(spark.createDataFrame(asked, "book_id long, seq long, pg_text string"), spark.createDataFrame(files, "book_id long, html string"))
    by = dict(files)
    for r in got.collect():
        clean = " ".join((r.pg_text or "").replace("’", "'").split())
        if r.book_id == 99 or r.pg_text is None:
            assert r.pg_file_line == 0
        else:
            assert r.pg_file_line == reference_line(by[r.book_id].split("\n"), clean), r
    assert got.count() == len(asked)
    told = locate.line_context(got, spark.createDataFrame(files, "book_id long, html string")).collect()
    assert all((r.context == "") == (r.pg_file_line == 0) or r.context == "" for r in told) and any("<-- error here" in r.context for r in told)


def test_leaves(spark):
    df = spark.createDataFrame([("book_0048.png", 7), (None, 7), ("cover.png", 3)], "image string, page long")
    assert [r[0] for r in df.select(locate.leaf_number(F.col("image"), F.col("page"))).collect()] == [47, 7, 3]

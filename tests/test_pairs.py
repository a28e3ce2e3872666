import random

from tests.compare import plain, sql_rows
from variorum import queries
from variorum.operators.pairs import linked_classes, near_pairs, nearest_pairs
from variorum.runtime import table

DATA = "/root/testdata/sf0.001"
#: all pairs of shared shingles, without a block
SELF_JOIN = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), met AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT a_id, b_id, i / (na + nb - i) AS jaccard FROM met WHERE i / (na + nb - i) > 0.5 AND i < na + nb - i"""


def test_pairs_of_the_tables_are_those_of_a_self_join(spark):
    for folder in (DATA, "/root/testdata/sf0.01"):
        got = sorted((str(r.a_id), str(r.b_id), plain(r.jaccard)) for r in near_pairs(table(spark, folder, "documents")).collect())
        assert got and got == sql_rows(SELF_JOIN, folder)[0]


def test_all_pairs_above_half_are_found(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(20):
        base = [f"w{rng.randint(0, 900)}" for _ in range(90)]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(90)] = f"E{rng.randint(0, 4000)}"
            texts.append(" ".join(own))
    texts += [texts[0], "  " + texts[1].replace(" ", "\n"), None, "", "a b c d", "a b c d e"]
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in enumerate((t or "").split() for t in texts)}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    want = {k: x for k, x in alike.items() if 0.5 < x < 1}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_pairs(df).collect()
    assert len(want) > 100 and {(r.a_id, r.b_id): r.jaccard for r in got} == want and len(got) == len(want)
    assert all((r.a_text, r.b_text) == (texts[r.a_id], texts[r.b_id]) for r in got)


def test_links_of_classes_and_the_likest_of_smaller_id(spark):
    for folder in (DATA, "/root/testdata/sf0.01"):
        docs = table(spark, folder, "documents")
        got = [(r.a_id, r.b_id, r.jaccard) for r in linked_classes(docs).collect()]
        pairs = [(r.a_id, r.b_id, r.jaccard) for r in near_pairs(docs).collect()]
        first = {b: a for a, b, j in got if j == 1}
        named = {}
        for a, b, j in pairs:
            x, y = sorted((first.get(a, a), first.get(b, b)))
            named[x, y] = j
        assert {(a, b): j for a, b, j in got if j < 1} == named and len(got) == len(named) + len(first)
        best = {}
        for (a, b), j in named.items():
            best[b] = min(best.get(b, (1, 0)), (-j, a))
        near = nearest_pairs(docs).collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert {r.b_id: (-r.jaccard, r.a_id) for r in near} == best and len(near) == len(best)
        assert all((r.a_text, r.b_text) == (texts[r.a_id], texts[r.b_id]) for r in near)


def test_pairs_of_odd_tables(spark):
    long = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, long, "x"), (3, None, "x"), (4, "", "x"), (None, long, "x")], "doc_id long, text string, cls string")
    assert [(r.a_id, r.b_id, r.jaccard) for r in linked_classes(df).collect()] == [(1, 2, 1.0)] and nearest_pairs(df).count() == 0
    assert linked_classes(df.filter("false")).count() == 0


def test_each_text_with_a_likest_one_is_a_book_of_its_own(spark):
    pairs = {(r.a_id, r.b_id) for r in nearest_pairs(table(spark, DATA, "documents")).collect()}
    got = [(r.a_id, r.book_id) for r in queries.QUERIES["edition_line_breaks"](spark, DATA).collect()]
    assert len(got) == len(pairs) and set(got) == pairs

"""Very long texts, columns of clashing names, nulls, repeats and empty tables, of each operator and stage."""

import random

import pytest

import corpus_pipeline as C
from variorum.llm import chat, decontaminate, fingerprint, html_extract, language, near_dedup, quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    return " ".join(f"{rng.choice(['house', 'river', 'stone', 'mountain', 'the', 'of', 'and'])}{rng.randint(0, 3000)}" + rng.choice(["", "", "", "."]) for _ in range(60000))


def test_very_long_texts(spark, long_text):
    words = long_text.split()
    near = " ".join(words[:30000] + ["changed"] + words[30001:])
    docs = spark.createDataFrame([(1, long_text), (2, near), (3, "short text of five words"), (4, None)], "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {1: (len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}), 1), 2: (found[2][0], 1), 3: (1, 3), 4: (0, 4)}
    items = spark.createDataFrame([(7, " ".join(words[59000:59040])), (8, "words that stand nowhere in there at all")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()) == [(1, 7), (2, 7)]
    like = {r.doc_id: r for r in fingerprint.edit_likeness(docs).collect()}
    assert like[1].n_chars == len(long_text) and like[2].near_next > 0.9 and like[1].near_edited < 1
    scored = {r.doc_id: r.quality_score for r in quality.score(docs).collect()}
    assert set(scored) == {1, 2, 3, 4} and scored[4] == 0


def test_very_long_pages_and_conversations(spark, long_text):
    paragraphs = [" ".join(long_text.split()[i : i + 60]).capitalize() + "." for i in range(0, 60000, 60)]
    html = "<html><body><nav><a href=x>menu</a></nav><article><h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.org/", html, "x"), (2, None, "", "x"), (None, "u", None, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.digest(pages).collect()}
    assert got[1][0].count("\n") >= 990 and got[1][1] == len(got[1][0]) and got[2] == ("", 0) and got[None] == ("", 0)
    model = language.fit_text(spark.read.parquet(f"{DATA}/documents.parquet"))
    named = pages.withColumnRenamed("text", "host").selectExpr("*", "'y' as declared", "1 as id", "2 as vote")
    said = language.identify(named, model)
    assert said.count() == 3 and "vote" not in said.columns
    turns = spark.createDataFrame([(1, 0, "user", long_text, "z"), (1, 1, "assistant", "<s>" + long_text, "z"), (2, 0, None, None, None)], "conv_id long, turn long, role string, text string, formatted string").withColumnRenamed("formatted", "id")
    made = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert chat.read_turns(made[1].formatted) == [("user", long_text), ("assistant", "<s>" + long_text)] and chat.read_loss(made[1].formatted, made[1].loss) == ["<s>" + long_text]
    assert chat.read_turns(made[2].formatted) == [("", "")]


def test_quality_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "fine words here and there.", 1.0, 2.0, "x"), (2, None, 1.0, 2.0, "x")], "doc_id long, text string, __posterior double, __score double, draw string")
    got = quality.score(df)
    assert got.columns == [*df.columns, "quality_posterior", "quality_score", "quality_keep"] and [r["__score"] for r in got.collect()] == [2.0, 2.0]


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with names that operators use."""
    text = "It was a fine day, and the house by the river stood in the sun. " * 6
    rows = [(1, text, "en", "s", len(text), 1, "x"), (1, text, "en", "s", len(text), 1, "x"), (2, text + "More of it.", None, None, None, None, None), (3, "", "en", "s", 0, 2, "y"), (4, None, "en", "s", None, 2, "y"), (None, text, "en", "s", 5, 3, "z"), (5, "Write to me@mail.example.com about the house and the river, which is fine. " * 4, "en", "s", 1, 4, "z"), (6, text * 400, "en", "s", 2, 5, "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, spans string")


@pytest.mark.parametrize("stage", C.STAGES, ids=[n for n, _ in C.STAGES])
def test_stages_on_odd_tables(spark, stage):
    name, run = stage
    docs = odd_documents(spark)
    got = run(spark, docs, DATA)
    rows = got.collect()
    assert run(spark, docs.filter("false"), DATA).count() == 0
    if name == "packing":
        assert len({r.doc_id for r in rows}) == 7 and sum(r.length for r in rows if r.doc_id in (3, 4)) == 2
        return
    assert got.columns == docs.columns
    texts = sorted((r.doc_id or 0, r.text or "") for r in rows)
    given = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    if name == "quality":
        assert set(texts) <= set(given) and texts.count((1, given[1][1])) in (0, 2) and not [t for t in texts if t[0] in (3, 4)]
    elif name == "near_duplicates":
        assert [t[0] for t in texts] == [0, 1, 3, 4, 5, 6] or [t[0] for t in texts] == [0, 1, 3, 4, 5]
    elif name == "decontamination":
        assert texts == given
    else:
        assert len(texts) == len(given) and all("@" not in t for _, t in texts) and [r.text for r in rows if r.doc_id == 4] == [None]
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)

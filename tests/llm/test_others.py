import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from tests.compare import spark_rows, sql_rows
from variorum.llm import chat, decontaminate, html_extract, language, pii, quality, queries

DATA = "/root/testdata/sf0.001"


# --- chat

_pieces = st.lists(st.sampled_from(["<", "|", "\\", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "turn|>", "end|>\n", "é", "\n", "a", "<|turn|>user\n"]), max_size=12).map("".join)


@given(st.lists(st.tuples(_pieces, _pieces), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_formatting_round_trips(turns):
    table = pa.table({"id": pa.array([1] * len(turns), pa.int64()), "role": pa.array([r for r, _ in turns], pa.string()), "text": pa.array([t for _, t in turns], pa.string())})
    row = chat._format(table, "assistant").to_pylist()[0]
    assert chat.read_turns(row["formatted"]) == turns
    assert chat.read_loss(row["formatted"], row["loss"]) == [t for r, t in turns if r == "assistant"]
    inside = re.sub(r"<\|turn\|>|<\|end\|>", "", row["formatted"])
    assert not re.search(r"<\||\[/?INST\]|</?s>|<</?SYS>>", inside)


def test_conversations_over_batches(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("hi", None, "<|end|>", "x" * 50))) for c in [*range(30), None] for t in range(rng.randint(1, 9))] + [(99, None, "user", "first"), (99, 0, "assistant", "b"), (99, 0, "assistant", "a")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        assert chat.read_turns(r.formatted) == [(x[2] or "", x[3] or "") for x in own]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_query_has_the_extra_conversation(spark):
    got = {r.conv_id: r for r in queries.op8_chat_formatting(spark, DATA).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(said)
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


# --- decontamination


def test_decontamination_gives_the_rows_of_its_sql(spark):
    got, columns = spark_rows(queries.op10_decontamination(spark, DATA))
    want, named = sql_rows(queries.SQL["op10_decontamination"], DATA)
    assert columns == named and got == want and got


def test_containment_edges(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    docs = [(1, "pre " + item.upper() + " post"), (2, " ".join(words[:35])), (3, " ".join(words[:20])), (4, None), (None, item), (5, "Two, words!"), (5, "Two, words!"), (6, "")]
    items = [(1, item), (2, "two words"), (3, None), (4, "..."), (None, item), (1, item)]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n string, k int")
    got = decontaminate.contained_items(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got.collect()) == [(1, 1, 36, 36), (2, 1, 36, 31), (5, 2, 1, 1)]
    assert decontaminate.decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).count() == 4
    assert decontaminate.contained_items(d.filter("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contained_items(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- personal data


@given(st.lists(st.sampled_from(["a.b", "@", "mail.example.com", " ", "1.2.3.4", "999.1.1.1.5", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "+", "12", ".", "-", "é", "x@y", "(", "0"]), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans_are_the_patterns_matches(text):
    want = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[k]
            if ok:
                want.append((m.start(), k, m.end()))
    assert pii.base_spans(text) == sorted(want)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger(embed=3, hidden=2)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    chars, tags = rng.integers(0, 130, (3, 5)), rng.integers(0, pii.TAGS, (3, 5))

    def loss():
        return tagger.gradients(chars, tags)[0]

    _, grad = tagger.gradients(chars, tags)
    for name, p in tagger.p.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in p.shape) if name != "E" else (chars[0, 0], 1)
            was = p[at]
            p[at] = was + 1e-4
            up = loss()
            p[at] = was - 1e-4
            down = loss()
            p[at] = was
            assert abs((up - down) / 2e-4 - grad[name][at]) < 2e-3


def test_tagger_on_held_out_passages():
    tagger, rng = pii.trained(), random.Random(99)
    right = found = there = 0
    plain = [0, 0]  # spans that no pattern finds
    for _ in range(300):
        text, spans = pii.labelled_example(rng)
        got = {(s, e, pii.TAGGED[k]) for s, k, e in pii.tagged_spans(tagger, [text])[0]}
        right += len(got & set(spans))
        found += len(got)
        there += len(spans)
        base = {(s, e) for s, _, e in pii.base_spans(text)}
        mine = [x for x in spans if x[:2] not in base]
        plain = [plain[0] + len(got & set(mine)), plain[1] + len(mine)]
    assert right / found > 0.9 and right / there > 0.9 and plain[0] / plain[1] > 0.9


def test_windows_hold_every_character_and_decoding_is_plain_viterbi():
    for n in [*range(0, 1200, 7), 448, 511, 512, 513, 960, 961]:
        seen = np.zeros(n, bool)
        for s, e in pii.windows(n):
            assert 0 < e - s <= pii.WINDOW
            seen[s:e] = True
        assert seen.all()
    rng = np.random.default_rng(3)
    for k in range(6):
        tagger = pii.Tagger(embed=4, hidden=3, seed=k)
        tagger.p["T"] = rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32) * 2
        tagger.p["o"][0] = k  # from tags in all windows to tags in few
        chars = rng.integers(0, 130, (40, 12))
        e, T = tagger.emissions(chars)[0].transpose(1, 0, 2), tagger.p["T"]
        assert np.abs(tagger.scores(chars).transpose(2, 0, 1) - e).max() < 1e-4
        for own, tags in zip(e, tagger.decode(chars)):
            score, back = own[0], []
            for x in own[1:]:
                back.append((score[:, None] + T).argmax(0))
                score = (score[:, None] + T).max(0) + x
            path = [int(score.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert path[::-1] == tags.tolist()


def test_letters_alone_far_from_digits_are_found_as_secrets():
    rng, tagger, hits = random.Random(5), pii.trained(), 0
    words = ["the thonre was reis on anly", "und der zutzau enßpf die", "les ciónmente osí de la"]
    for k in range(60):
        secret = "".join(rng.choice(pii._UPPER + pii._LOWER) for _ in range(40))
        before, after = " ".join(rng.choices(words, k=k % 50)), " ".join(rng.choices(words, k=20))
        text = f"{before} token = {secret} {after}"
        at = text.index(secret)
        hits += (at, pii.TAGGED.index("secret"), at + 40) in pii.tagged_spans(tagger, [text])[0]
    assert hits >= 54


class Exact:
    """Tags runs of hexadecimal digits as secrets, as far as the window shows them."""

    def decode(self, chars):
        on = np.isin(chars, [ord(c) for c in "0123456789abcdef"])
        out = np.where(on, 2 + 2 * pii.TAGGED.index("secret"), 0)
        out[:, 1:] -= on[:, 1:] & ~on[:, :-1]
        return out


@pytest.mark.parametrize("n", [40, 64, 65, 400, 448, 449, 512, 513, 900, 1500])
def test_secrets_longer_than_a_stride_are_one_span(n):
    secret, kind = ("0123456789abcdef" * 100)[:n], pii.TAGGED.index("secret")
    for at in [*range(0, 520, 13), 383, 384, 385, 447, 448, 449, 511, 512]:
        for tail in (0, 60, 500):
            text = ("x@" * 300)[:at] + secret + "x@" * tail
            assert pii.tagged_spans(Exact(), [text])[0] == [(at, kind, at + n)], (at, tail)
    two = "x@ " * 9 + secret + " x " + secret + " x"
    assert [e - s for s, _, e in pii.tagged_spans(Exact(), [two])[0]] == [n, n]


def test_pii_edges_and_redaction(spark):
    long = "x " * 3000 + "me@mail.example.com" + " y" * 3000
    rows = [(1, "call +1 (555) 123-4567 or me@mail.example.com", 5), (2, None, 6), (3, "", 7), (None, "1.2.3.4", 8), (4, long, 9), (4, long, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert [(x.kind, x.start, x.end) for x in got[4]] == [("email", 6000, 6019)] and not got[2] and not got[3]
    said = {(r.doc_id, r.spans): r.text for r in pii.redact(df).collect()}
    assert said[1, 5] == "call <PHONE> or <EMAIL>" and said[2, 6] is None and said[None, 8] == "<IP>"
    assert pii.find_pii(df.filter("false")).count() == 0


# --- pages


def test_chain_on_held_out_pages():
    chain, rng, right = html_extract.trained(), random.Random(77), 0
    for _ in range(200):
        page, main = html_extract.labelled_page(rng)
        blocks = html_extract.leaf_blocks(page)
        right += chain.decode(html_extract.features(blocks)) == [int(b.text in main) for b in blocks]
    assert right > 185


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    chain = html_extract.Chain({"a": 0, "b": 1, "c": 2}, rng.standard_normal((3, 2)), rng.standard_normal((2, 2)))
    for _ in range(30):
        rows = [[x for x in "abc" if rng.random() < 0.5] for _ in range(rng.integers(1, 7))]
        scores = {}
        for code in range(1 << len(rows)):
            path = [code >> i & 1 for i in range(len(rows))]
            s = sum(chain.weights[chain.names[f], y] for row, y in zip(rows, path) for f in row) + sum(chain.moves[i, j] for i, j in zip(path, path[1:]))
            scores[tuple(path)] = s
        assert tuple(chain.decode(rows)) == max(scores, key=scores.get)


@pytest.mark.parametrize(("page", "text"), [("<html><body><nav><a href=x>m</a></nav><article><h1>T</h1><p>a&nbsp;b &lt;c&gt;<br>d<p>e.</article><footer>&copy; f</footer>", "T\na b <c> d\ne."), ("plain words, no marks.", "plain words, no marks."), ("", ""), (None, ""), ("<script>x</script>", "")])
def test_main_text(page, text):
    assert html_extract.main_text(page or "", html_extract.trained()) == text


def test_extraction_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, "<p>x y.</p>", "old")], "page_id long, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_extract.extract(df).collect())
    assert got == [(1, ""), (1, "x y.")] and html_extract.extract(df.filter("false")).count() == 0


def test_language(spark):
    model = language.fit_text(spark.read.parquet(f"{DATA}/documents.parquet"))
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = language.identify(pages, model).collect()
    assert len(got) == pages.count() and np.mean([r.lang == r.declared for r in got]) > 0.9
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    odd = spark.createDataFrame([(1, None, None), (2, "nonsense", ""), (2, "nonsense", ""), (None, "http://a.de/", '<html lang="de">')], "page_id long, url string, html string")
    assert language.identify(odd, model).count() == 4 and language.identify(odd.filter("false"), model).count() == 0


# --- quality


def test_em_finds_the_labellers_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.8
    sure = np.array([0.95, 0.9, 0.85, 0.9, 0.95])
    votes = np.where(rng.random((4000, 5)) < sure, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    chance, share = quality.fit_votes(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05 and np.abs(chance[:, 1, 1] - sure).max() < 0.06
    assert ((quality.posterior(votes, chance, share) > 0.5) == good).mean() > 0.97


def test_quality_on_reviewers_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(docs).join(labels, "doc_id").select("quality_keep", "quality").collect()
    assert np.mean([r.quality_keep == (r.quality == 1) for r in got]) > 0.97


def test_quality_edges(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "fine words here and there.", 1.0), (3, "fine words here and there.", 1.0), (None, "***", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    got = quality.score(df).collect()
    assert len(got) == 5 and all(r.quality_score == 0 and not r.quality_keep for r in got if not r.text)
    assert quality.score(df.filter("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns and docs.count() > 0
    assert docs.agg({"doc_tokens": "max"}).first()[0] > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_run_over_their_tables(spark, name):
    """The columns of the contracts, and a row for each row of the table that a query is about."""
    got = queries.QUERIES[name](spark, DATA)
    rows = got.count()
    tables = {"op6": ("pages", 0), "op7": ("pages", 0), "op8": None, "op10": None, "op4": None}
    about = tables.get(name.split("_")[0], ("documents", 0))
    if about:
        assert rows == spark.read.parquet(f"{DATA}/{about[0]}.parquet").count()
    wanted = {
        "op1": "doc_id n_shingles component_id kept",
        "op3": "doc_id n_words n_removed kept_sha256",
        "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op5": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op7": "page_id url text n_chars",
        "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op9": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    }.get(name.split("_")[0], "")
    assert set(wanted.split()) <= set(got.columns)


def test_pii_query_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op9_pii(spark, DATA).collect():
        base = pii.base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        said = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(","))

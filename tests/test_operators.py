import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from variorum.functions import lexicon
from variorum.functions import text as T
from variorum.operators import align, diff, editions, gaps, images, pages, poetry, report, rules, score, variants
from variorum.sources import editions as src


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_normalize_for_diff_composes_and_joins(spark):
    c = T.normalize_for_diff(F.col("t"), True)
    assert one(spark, c, t="_some_ thing- \n more[12]  é²") == "some thingmoreFOOTNOTE éFOOTNOTE"


@pytest.mark.parametrize(("a", "b", "kind"), [("cat", "Cat", "formatting_error"), ("word,", "“word”", "punctuation_diff"), ("tne", "the", "ocr_scanno"), ("house", "breakfast", "wrong_word")])
def test_category(spark, a, b, kind):
    assert one(spark, diff.category(F.col("a"), F.col("b")), a=a, b=b) == kind


def test_opcodes_are_those_of_difflib():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert diff.opcodes(a, b) == difflib.SequenceMatcher(None, a, b, False).get_opcodes()


def test_stitched_diff_finds_the_changed_word(spark):
    base = "The committee considered the approxmately long letter " + "and then went on to other things that mattered more " * 3
    other = base.replace("approxmately", "approximately")
    pairs = spark.createDataFrame([(1, base, other), (2, base, base), (3, None, base)], "k long, a_text string, b_text string")
    found = diff.candidates(diff.hunks(pairs, ["k"], mode="stitched")).filter("k < 3").collect()
    assert [(r.k, r.pg_text, r.scan_text, r.category) for r in found] == [(1, "approxmately", "approximately", "ocr_scanno")]


def test_gap_rules():
    assert diff.gap_hunks([], ["a", "b"], 3, 4) == [("extra", "", "a", 3, 4), ("extra", "", "b", 3, 5)]
    assert diff.gap_hunks(list("abcd"), [], 0, 0) == []
    assert diff.gap_hunks([f"a{i}" for i in range(10)], [f"b{i}" for i in range(10)], 0, 0) == []


@pytest.mark.parametrize(("a", "b", "reason"), [("--", "—", "typography"), ("someone", "some one", "modernization"), ("colour", "color", "edition"), ("theatre", "theater", "us_uk"), ("hello,", "hello", "punctuation"), ("some- thing", "something", "punctuation"), ("tne", "the", "none"), ("x", "(absent in scan)", "artifact")])
def test_rule_chain(spark, a, b, reason):
    got = one(spark, rules.verdict(F.col("a"), F.col("b"), F.lit("wrong_word")), a=a, b=b)
    assert got.reason == reason


def test_strict_rules_keep_and_recategorise(spark):
    rows = spark.createDataFrame([("--", "—", "c"), ("colour", "color", "c"), (None, "x", "c")], "pg_text string, scan_text string, category string")
    assert rules.apply_rules(rows).count() == 2
    kept = rules.apply_rules(rows, strict=True)
    assert kept.count() == 3 and kept.filter("category = 'edition_variant'").count() == 1


def test_plurals_are_no_suffix_fragments(spark):
    test = rules.is_suffix(F.col("a"), F.col("b"))
    assert one(spark, test, a="morning", b="ning") is True or one(spark, test, a="morning", b="orning") is True
    assert one(spark, test, a="cats", b="cat") is False
    assert one(spark, test, a="dishes", b="dish") is False


@pytest.mark.parametrize(("a", "b", "kind", "level"), [("he did not go", "he did go", "textual_variant", "major"), ("theatre", "theater", "spelling_change", "minor"), ("a, b", "a b", "punctuation_variant", "minor"), ("(absent in PG)", "one two three", "added_content", "moderate"), ("a  b", "a b", "normalization", "trivial")])
def test_variants(spark, a, b, kind, level):
    assert one(spark, variants.category(F.col("a"), F.col("b")), a=a, b=b) == kind
    assert one(spark, variants.significance(F.col("a"), F.col("b"), F.lit(kind)), a=a, b=b) == level


@pytest.mark.parametrize(("word", "stem"), [("stopped", "stop"), ("loved", "love"), ("boxes", "box"), ("running", "run"), ("kindly", "kind"), ("john's", "john"), ("kindest", "kind"), ("lovingly", "loving")])
def test_stems(spark, word, stem):
    assert stem in one(spark, lexicon.stems(F.col("w")), w=word)


SPELT = """honor honour,dishonored dishonoured,colorless colourless,neighborhood neighbourhood,unfavorable unfavourable,laborers labourers,behavioral behavioural,armored armoured,odors odours,centered centred,
meagerly meagrely,somber sombre,specter spectre,sepulcher sepulchre,organization organisation,analyzing analysing,paralyze paralyse,defenses defences,pretense pretence,licensing licencing,practise practice,analogs analogues,cataloging cataloguing,
epilog epilogue,traveler traveller,signaling signalling,fueled fuelled,sniveling snivelling,quarreled quarrelled,groveling grovelling,counselor counsellor,connection connexion,judgment judgement,abridgments abridgements,etiology aetiology,gynecological gynaecological,
pediatrics paediatrics,orthopedic orthopaedic,esthetics aesthetics,archeology archaeology,encyclopedia encyclopaedia,maneuvering manoeuvring,eon aeon,fetal foetal,estrogen oestrogen,esophagus oesophagus,edema oedema,hemorrhage haemorrhage,
hyena hyaena,gonorrhea gonorrhoea,aging ageing,aluminum aluminium,artifacts artefacts,carburetor carburettor,cooperation co-operation,cyclopedia cyclopaedia,czar tsar,draft draught,fiance fiancé,gray grey,grayish greyish,skepticism scepticism,
molder moulder,smoldering smouldering,mustache moustache,pajamas pyjamas,plowed ploughed,stories storeys,programs programmes,tons tonnes,medieval mediaeval,utilized utilised,agonize agonise,dispatched despatched,fulfillment fulfilment"""


def test_spelling_rules_and_pairs(spark):
    pairs = [tuple(x.split()) for x in SPELT.replace("\n", "").split(",")]
    no = [("she", "shoe"), ("pet", "poet"), ("filed", "filled"), ("hor", "hour"), ("cat", "cats"), ("color", "Color"), ("for", "four"), ("wold", "would"), ("", ""), (None, "x"), ("caled", "called")]
    df = spark.createDataFrame([(a, b, True) for a, b in pairs] + [(b.upper(), f" {a}", True) for a, b in pairs] + [(a, b, False) for a, b in no], "a string, b string, want boolean")
    assert df.filter(lexicon.is_us_uk(F.col("a"), F.col("b")) != F.col("want")).collect() == []
    assert df.filter(lexicon.is_us_uk(F.col("a"), F.col("b"), [("cat", "cats")])).filter("a = 'cat'").count() == 1
    assert 0 < len(lexicon.SPELLINGS) < 200



@pytest.mark.parametrize(("a", "b", "want"), [("“word,", '"ward,', ("word", "ward")), ("a.", "b.", ("a", "b")), ("...", "...", ("...", "...")), ("(x)", "[x]", ("(x)", "[x]"))])
def test_trim_shared_edges(a, b, want):
    assert score._trimmed(a, b) == want


def test_near_repetitions_are_folded(spark):
    rows = spark.createDataFrame([(1, k, at, "a", "b") for k, at in enumerate((0, 30, 49, 50, 90, 120))], "book long, seq long, pg_offset long, pg_text string, scan_text string")
    assert sorted(r.pg_offset for r in score.dedup_near(rows, ["book"]).collect()) == [0, 50, 120]


def test_placement_is_monotonic_and_steps_back_little():
    placed = align.place_monotonic([(1, [(100, 1.0)]), (2, [(50, 1.0), (500, 0.6)]), (3, [(450, 0.9)]), (4, [])])
    assert placed == {1: 100, 2: 500, 3: 450}


def test_lcs_pairs_are_longest():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = align.lcs_pairs(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert len(pairs) == table[-1, -1]


def test_one_content_hole_of_seven_words():
    base = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"
    page = base.replace("hotel india", "hotel seven words that nobody ever wrote there india")
    found = gaps.holes(gaps.BookIndex(base), base, page)
    assert [(n, level) for _, n, level, _, _ in found] == [(7, "medium")] and found[0][3:] == ("foxtrot golf hotel", "india juliet kilo")
    assert gaps.holes(gaps.BookIndex(base), base, " ".join(base.split()[::-1])) == []


def test_partial_gap():
    base = "one two three four five six"
    found = gaps.partial(gaps.BookIndex(base * 3), base, base + " and then a lot of text that is not there at all")
    assert len(found) == 1 and found[0][1] == 12


def test_segments_and_islands(spark):
    al = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 200), (1, 3, 900, 1000), (1, 5, 1000, 1100)], "conv_id long, scan_page long, pg_start long, pg_end long")
    assert [r.segment_id for r in pages.segments(al).orderBy("scan_page").collect()] == [1, 1, 2, 3]
    assert [r.run_start for r in pages.islands(al, "conv_id", "scan_page").orderBy("scan_page").collect()] == [1, 1, 1, 5]


def test_nearest_occurrence(spark):
    c = pages.nearest_occurrence(F.col("t"), F.col("w"), F.lit(9))
    assert one(spark, c, t="ab x ab yy ab", w="ab") == 11
    assert one(spark, c, t="none", w="ab") is None
    assert one(spark, c, t="a.b a+b", w="a+b") == 4


def test_page_images(spark):
    rng = np.random.default_rng(1)
    blank = np.full((400, 300), 255, np.uint8)
    text = blank.copy()
    text[rng.random(text.shape) < 0.1] = 0
    rows = [(1, 400, 300, blank.tobytes()), (2, 400, 300, text.tobytes()), (3, 4, 3, b"xx"), (4, None, None, None)]
    got = images.classify(spark.createDataFrame(rows, "page_num long, height long, width long, pixels binary"))
    assert [r.has_text for r in got.orderBy("page_num").collect()] == [False, True, True, True]


def test_poetry(spark):
    said = ['```json\n{"poem_title": "Ode", "stanzas": [{"label": "I", "lines": [["first", 0], {"text": "second", "indent": 2}]}]}\n```', '{"poem_title": "Ode", "stanzas": [{"lines": ["third"]}], "is_continuation": true}', 'broken ["a line", 4], ["b", 0]', None]
    got = poetry.parse(spark.createDataFrame(list(enumerate(said)), "page_num long, response string"))
    texts = [r.t for r in got.orderBy("page_num").select(poetry.transcription(F.col("poem")).alias("t")).collect()]
    assert texts == ["first\n  second", "third", "    a line\nb", ""]
    ode = poetry.merge(got).filter("poem_title = 'Ode'").first()
    assert ode.pages == [0, 1] and [s.stanza_number for s in ode.stanzas] == [1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "43.txt").write_text("Title: A Tale\nAuthor: Someone\n\n*** START OF THE PROJECT GUTENBERG EBOOK ***\nCHAPTER I\n\nOne line\nand more.\n\n*** END OF THE PROJECT GUTENBERG EBOOK ***\nlicence")
    (tmp_path / "44-h.htm").write_text("<html><head><title>x</title></head><body><h1>Page</h1><p>a &amp; b</p></body></html>")
    got = {r.book_id: r for r in src.parse_books(src.read_texts(spark, str(tmp_path))).collect()}
    assert got[43].title == "A Tale" and got[43].author == "Someone" and got[43].paragraphs == ["CHAPTER I", "One line and more."]
    assert got[44].title == "Page" and got[44].paragraphs == ["Page", "a & b"]
    assert src.parse_spec("text:/a:b") == ("text", "/a:b")
    with pytest.raises(ValueError):
        src.parse_spec("other:x")
    assert src.synthetic_pages("a" * 900 + "\n\n" + "b" * 900 + "\n\n" + "c" * 900) == ["a" * 900 + "\n\n" + "b" * 900, "c" * 900]


def test_log_last_line_counts(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"page_num": 1, "transcription": "old", "success": true}\nbroken\n{"page_num": 1, "transcription": "new", "success": true}\n{"page_num": 2, "transcription": "x", "success": false}\n')
    assert [(r.page_num, r.text) for r in src.best_pages(src.read_log(spark, str(tmp_path / "log.jsonl"))).collect()] == [(1, "new")]


def test_volumes_are_numbered_on(spark):
    rows = spark.createDataFrame([(2, 1), (1, 7), (1, 9)], "volume long, page long")
    assert [r.page_num for r in src.volume_pages(rows).orderBy("volume", "page").collect()] == [0, 1, 2]


def test_sentence_and_derived_columns(spark):
    text = "One here. Two _is_\nthe word! Three.\n\nFour goes on\n\nlast"
    place = lambda w: report.sentence_at(F.col("t"), F.lit(text.index(w)), F.lit(len(w)))
    assert one(spark, place("the"), t=text) == "Two is the word!"
    assert one(spark, place("Four"), t=text) == "Four goes on"
    assert one(spark, report.sentence_at(F.col("t"), F.lit(999), F.lit(1)), t=text) == ""
    kind = report.derived_category(F.col("c"), F.col("v"))
    assert [one(spark, kind, c=c, v=v) for c, v in (("alignment_artifact", "pg_correct"), ("wrong_word", "pg_correct"), ("wrong_word", "ambiguous"), ("wrong_word", "?"))] == ["alignment_artifact", "intentional_change", "wrong_word", "ambiguous"]
    assert [one(spark, report.severity(F.col("c")), c=c) for c in ("missing_content", "wrong_word", "punctuation_diff", "formatting_error", "x")] == ["critical", "high", "medium", "low", "info"]


def test_clues(spark):
    header = "Title: X\nPublished by London: Macmillan and Co. 1884\nProduced by A Person\nSource: https://archive.org/details/scan123/page\nA first edition"
    df = spark.createDataFrame([(header,), ("nothing",)], "h string")
    got = [r.asDict() for r in df.select(*(c.alias(k) for k, c in editions.clues(F.col("h")).items())).collect()]
    assert got[0] == {"pg_publisher": "Macmillan and Co. 1884", "pg_city": "London", "pg_year": "1884", "pg_first": True, "pg_source_scan": "scan123", "pg_producer": "A Person"}
    assert got[1]["pg_publisher"] == "" and got[1]["pg_year"] == "" and got[1]["pg_first"] is False


def test_report(spark):
    rows = [(1, 1, "approxmately", "approximately", "ocr_scanno", 0.9, 5, 3), (1, 2, "a", "(absent in scan)", "extra_word", 0.9, 1, 3), (1, 3, "x", "y", "alignment_artifact", 0.1, 1, 4)]
    errors = spark.createDataFrame(rows, "book_id long, seq long, pg_text string, scan_text string, category string, confidence double, pg_file_line long, scan_page long")
    assert [r.text for r in report.errata_lines(errors).collect()] == ["line 5: approxmately ==> approximately"]
    assert report.summary(errors).first().asDict() == {"book_id": 1, "total_candidates": 2, "high_confidence": 2, "medium_confidence": 0, "low_confidence": 0, "pages_checked": 2}
    assert report.error_json(errors).count() == 2
    assert [report.exit_code(*x) for x in ((1, 2), (0, 2), (0, 0))] == [2, 1, 0]

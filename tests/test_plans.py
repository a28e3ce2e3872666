import random

from pyspark.sql import functions as F

from variorum.operators import score
from variorum.plans import compare, errata, verify


def sentence(rng):
    words = ["".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(9, 16))]
    return " ".join(words).capitalize() + "."


def book(seed=4, n=60):
    rng = random.Random(seed)
    return [" ".join(sentence(rng) for _ in range(6)) for _ in range(n // 6)]


def test_errata_finds_planted_misprints(spark):
    parts = book()
    body = "\n\n".join(parts)
    wrong = [p.split() for p in parts]
    for k in (1, 4, 7):
        wrong[k][20] = wrong[k][20][:-2] + "xx"
    base = "\n\n".join(" ".join(w) for w in wrong)
    books = spark.createDataFrame([(1, base)], "book_id long, body_text string")
    pages = spark.createDataFrame([(1, k, p) for k, p in enumerate(parts)], "book_id long, page_num long, text string")
    got = errata.run(books, pages)
    assert got.alignments.count() >= len(parts) - 1
    told = got.errors.filter("category in ('wrong_word', 'ocr_scanno')").collect()
    planted = {wrong[k][20] for k in (1, 4, 7)}
    assert planted <= {r.pg_text for r in told}
    exact = [r for r in told if r.pg_text in planted]
    assert all(r.confidence is not None and r.confidence > 0.4 for r in exact)
    assert got.gaps.filter("strategy = 'uncovered'").count() <= 1 and got.summary.count() == 1
    assert body


def test_comparison_classifies_spelling(spark):
    parts = book(9)
    a, b = parts[:], parts[:]
    middle = parts[3].split()
    half = len(middle) // 2
    a[3], b[3] = (" ".join([*middle[:half], word, *middle[half:]]) for word in ("theatre", "theater"))
    books = spark.createDataFrame([(1, "\n\n".join(a))], "book_id long, body_text string")
    pages = spark.createDataFrame([(1, k, p) for k, p in enumerate(b)], "book_id long, page_num long, text string")
    got = compare.run(books, pages).filter("pg_text like '%theatre%'").collect()
    assert [(r.variant, r.significance, r.b_page) for r in got] == [("spelling_change", "minor", 3)]


def test_verification(spark):
    rng = random.Random(2)
    lines = []
    for _ in range(80):
        line = ""
        while len(line) < 66:
            line += sentence(rng).split()[0] + " "
        lines.append(line[:68].strip() + "x" * (68 - len(line[:68].strip())))
    other = [x[:50] for x in lines]
    texts = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "short\nlines")], "book_id long, text string")
    scans = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other)), (3, "short\nlines")], "book_id long, text string")
    assert {r.book_id: r.result for r in verify.line_breaks(texts, scans).collect()} == {1: "match", 2: "mismatch", 3: "unable_to_determine"}
    cols = "book_id long, pg_publisher string, pg_year string, pg_title string, pg_city string, pg_first boolean, ia_publisher string, ia_date string, ia_title string, ia_city string, ia_description string, pg_source_scan string, ia_id string"
    clues = spark.createDataFrame([(k, "Harper", "1880", "A", "", False, "Harper", "1881", "A", "", "", "scan3" if k == 3 else None, f"scan{k}") for k in (1, 2, 3)], cols)
    got = {r.book_id: (r.result, r.confidence) for r in verify.run(clues, texts, scans).orderBy("book_id").select("book_id", "result", F.round("confidence", 2).alias("confidence")).collect()}
    assert got[1][0] == "match" and got[1][1] >= 0.8 and got[2] == ("match", 0.6) and got[3] == ("match", 1.0)


def test_accents_of_words_that_occur_once_are_replacements(spark):
    parts = book(5)
    a, b = (" ".join([*parts[4].split()[:20], word, *parts[4].split()[20:]]) for word in ("regime", "régime"))
    books = spark.createDataFrame([(1, "\n\n".join([*parts[:4], a, *parts[5:]]))], "book_id long, body_text string")
    pages = spark.createDataFrame([(1, k, p) for k, p in enumerate([*parts[:4], b, *parts[5:]])], "book_id long, page_num long, text string")
    got = errata.run(books, pages).replacements.filter("scan_root = 'régime'").collect()
    assert [(r.pg_root, r.caught, r.occurrences) for r in got] == [("regime", 1, 1)]


def test_promotion_of_accents(spark):
    rows = [(1, 1, 1, "role,", "rôle,"), (1, 2, 1, "Role,", "Rôle,"), (1, 1, 2, "known", "knówn"), (1, 1, 3, "two words", "twó words"), (1, 1, 4, "tne", "the"), (1, 1, 5, "absent", "absént"), (1, 1, 6, "a", "à"), (1, 1, 7, "<i>fete</i>", "fête"), (2, 1, 1, "role,", "rôle,"), (2, 1, 2, None, "é")]
    errors = spark.createDataFrame(rows, "book_id long, scan_page long, seq int, pg_text string, scan_text string")
    books = spark.createDataFrame([(1, "A Role, a role, known. tne a fetes"), (2, "the role, of it")], "book_id long, body_text string")
    known = spark.createDataFrame([("Known", "Knówn", 1, 2, [1])], "pg_root string, scan_root string, caught long, occurrences long, pages array<long>")
    got = score.promoted(errors, books, known)
    assert got.columns == known.columns
    assert sorted((r.pg_root, r.scan_root, r.caught, r.occurrences, r.pages) for r in got.collect()) == [("fete", "fête", 1, 1, []), ("role,", "rôle,", 2, 3, [])]

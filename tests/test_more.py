import random

from pyspark.sql import functions as F

from variorum.operators import anchors, dictionary
from variorum.streaming import tracker


def test_dictionary(spark):
    known = spark.createDataFrame([("run",), ("box",), ("well",), ("kind",), ("cafe",)], "entry string")
    words = spark.createDataFrame([(w,) for w in ("Running", "boxes", "well-kind", "well-x", "café", "tne", None, " ", "kind's")], "word string")
    got = {r.word: r.in_dictionary for r in dictionary.in_dictionary(words, known).collect()}
    assert got == {"Running": True, "boxes": True, "well-kind": True, "well-x": False, "café": True, "tne": False, None: False, " ": False, "kind's": True}
    cands = spark.createDataFrame([(k, s) for k, s in enumerate(("régime", "1,200", "Smith", "“kind,”", "tne", "...", "a running", None))], "k int, scan_text string")
    assert [r.valid for r in dictionary.validate(cands, known).orderBy("k").collect()] == [True, True, True, True, False, False, True, False]


def test_diacritics_and_proper_nouns(spark):
    pairs = spark.createDataFrame([("mediaeval", "mediæval"), ("regime", "régime"), ("a", "b"), ("1", "2")], "a string, b string")
    assert [r.x for r in pairs.select(dictionary.diacritic_change(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, False]
    book = spark.createDataFrame([(w,) for w in ("Frode", "Frode", "Kingdom", "kingdom")], "word string")
    got = {r.word: r.proper_noun for r in dictionary.proper_nouns(spark.createDataFrame([("Frode",), ("Kingdom",), ("Other",)], "word string"), book).collect()}
    assert got == {"Frode": True, "Kingdom": False, "Other": False}


def test_anchors_place_a_page():
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) + str(k) for k in range(600)]
    book = " ".join(words)
    page = " ".join(words[200:260])
    found = anchors.unique_anchors(page, book)
    assert len(found) == 60 and abs(anchors.page_start(found, page) - book.index(page)) < 30
    swapped = " ".join([*words[230:260], *words[200:230]])
    assert len(anchors.unique_anchors(swapped, book)) == 30
    assert anchors.unique_anchors("a b", book) == [] and anchors.page_start([], page) is None


def test_body_start(spark):
    prose = "It was late. The rain had come. He waited long for the others to arrive at last. " * 3
    text = "CONTENTS\n\nChapter list\n\nCHAPTER I\n\nshort\n\n" + prose.strip()
    rows = spark.createDataFrame([(text,), ("nothing here",), ("",)], "t string")
    assert [r.x for r in rows.select(anchors.body_start(F.col("t")).alias("x")).collect()] == [text.index("It was"), 0, 0]


def test_correction(spark):
    def book(b, error):
        return [(b, p, p * 1000, p * 1000 + 900, 0.5 + p / 100) for p in range(20)], [(b, p, p * 1000 + error(p)) for p in range(20)]

    rng = random.Random(1)
    cases = {1: lambda p: 10, 2: lambda p: 1500, 3: lambda p: 400 + 120 * p, 4: lambda p: rng.randint(-9000, 9000)}
    al, off = [], []
    for b, error in cases.items():
        x, y = book(b, error)
        al, off = al + x, off + y
    al += [(5, 1, 0, 10, 0.5)]
    got = anchors.correct(spark.createDataFrame(al, "book_id long, scan_page long, pg_start long, pg_end long, confidence double"), spark.createDataFrame(off, "book_id long, scan_page long, found long")).toPandas()
    assert got.groupby("book_id")["verdict"].first().to_dict() == {1: "ok", 2: "corrected", 3: "drift_corrected", 4: "failed", 5: "unknown"}
    assert len(got[got.book_id == 2]) == 16 and (got[got.book_id == 2].pg_start == got[got.book_id == 2].scan_page * 1000 + 1500).all()
    assert (got[got.book_id == 3].pg_start == got[got.book_id == 3].scan_page * 1120 + 400).all()


def test_tracker_in_batch_and_stream(spark, tmp_path):
    rows = [(b, p, 1000 * p + b, 0.9 if p % 4 else 0.1) for b in (1, 2) for p in range(1, 30)]
    df = spark.createDataFrame(rows, "book_id long, page_num long, pg_end long, confidence double")
    once = {(r.book_id, r.page_num): (r.expected, r.pace) for r in tracker.track(df).collect()}
    assert once[1, 1] == (0, 1500.0) and once[1, 29] == (27001 + 2 * 1000, 1000.0)
    for k in range(3):
        df.filter(f"page_num > {k * 10} and page_num <= {k * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    query = tracker.track(stream).writeStream.foreachBatch(lambda d, _: out.extend(d.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.book_id, r.page_num) for r in out} == set(once)
    assert tracker.window([], 5, 900) == (0, 900) and tracker.window([(1, 1000), (3, 5000)], 4, 99999) == (5000, 15000)

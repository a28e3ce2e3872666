"""Registered queries over pages, alignments, scores, editions and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.functions import lexicon
from variorum.functions import text as T
from variorum.operators import align, anchors, dictionary, editions, exports, gaps, locate, markdown, pages, score, sequential, stitched, verifier
from variorum.operators.pairs import nearest_pairs
from variorum.plans import compare, errata, verify
from variorum.registry import SQL, query
from variorum.runtime import cut, table
from variorum.sources import html as web
from variorum.streaming import events as stream
from variorum.streaming import tracker

NL = "chr(10)"
_TRIMMED = f"trim(coalesce(text, ''), ' ' || {NL} || chr(9) || chr(13))"
_MAP = f"""own AS (SELECT conv_id, turn, {_TRIMMED} AS page_text FROM conversations WHERE {_TRIMMED} <> ''),
    page_map AS (SELECT *, coalesce(sum(length(page_text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM own)"""
_TOK = r"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


@query("best_text_pages", "SELECT conv_id, turn, md5(CASE WHEN turn % 3 <> 0 THEN coalesce(text, '') ELSE reverse(left(text, 5)) END) AS text_md5 FROM conversations")
def best_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, every third with OCR text only."""
    vision, ocr = F.when(F.col("turn") % 3 != 0, F.col("text")), F.reverse(F.substring("text", 1, 5))
    return _pages(spark, sf_dir).select("conv_id", "turn", F.md5(T.best_text(vision, ocr)).alias("text_md5"))


@query("page_intervals", f"WITH {_MAP} SELECT conv_id, turn, start_offset, start_offset + length(page_text) AS end_offset FROM page_map")
def page_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A60, W9, J13."""
    return pages.page_map(_pages(spark, sf_dir)).select("conv_id", "turn", "start_offset", "end_offset")


@query("stitched_books", f"WITH {_MAP} SELECT conv_id, md5(string_agg(page_text, ' ' ORDER BY turn)) AS book_md5, length(string_agg(page_text, ' ' ORDER BY turn)) AS n_chars FROM page_map GROUP BY conv_id")
def stitched_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A58, A60."""
    return pages.stitched(_pages(spark, sf_dir)).select("conv_id", F.md5("book_text").alias("book_md5"), F.length("book_text").cast("long").alias("n_chars"))


@query("token_page_map", f"WITH {_MAP}, t AS (SELECT conv_id, turn, unnest({_TOK.format(c='page_text')}) AS token, unnest(range(len({_TOK.format(c='page_text')}))) AS i FROM own) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS token_no, token, turn AS page_num FROM t")
def token_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 to J11, W8."""
    return pages.token_pages(_pages(spark, sf_dir))


# --- phrases

_LETTER_WORDS = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]+$'))"


@query(
    "phrase_hits",
    f"""WITH i AS (SELECT item_id, array_to_string({_LETTER_WORDS.format(c="text")}[1:8], ' ') AS phrase FROM benchmark WHERE len({_LETTER_WORDS.format(c="text")}) >= 8), d AS (SELECT doc_id, {_LETTER_WORDS.format(c="text")} AS w FROM documents),
    g AS (SELECT doc_id, unnest(range(len(w) - 7)) AS word_pos, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS phrase FROM d WHERE len(w) >= 8) SELECT doc_id, item_id, word_pos FROM g JOIN i USING (phrase)""",
)
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a benchmark item's first eight words stand in a document."""
    return align.phrase_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", align.letter_words(F.col("text")).alias("w")).filter("size(w) >= 8").select("item_id", F.slice("w", 1, 8).alias("phrase")), 8)


_COMMON = ", ".join(f"'{w}'" for w in lexicon.COMMON_WORDS)


@query(
    "distinctive_phrases",
    f"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(substring(text, 61), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 30) AS a, list_filter(list_transform(string_split_regex(substring(text, 61), ';\\s+'), lambda x: trim(x)), lambda x: length(x) > 40) AS b FROM conversations WHERE length(text) >= 80),
    e AS (SELECT conv_id, turn, unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS s, unnest(range(len(CASE WHEN len(a) > 0 THEN a ELSE b END))) AS pos FROM s), w AS (SELECT conv_id, turn, pos, {_LETTER_WORDS.format(c="s")} AS w FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(w) + 2 * len(list_filter(w, lambda x: length(x) > 3 AND x NOT IN ({_COMMON}))) DESC, pos) AS rank FROM w WHERE len(w) >= 8)
    SELECT conv_id, turn, rank::INT AS rank, array_to_string(CASE WHEN len(w) > 25 THEN w[1:20] ELSE w END, ' ') AS phrase FROM r WHERE rank <= 5""",
)
def distinctive_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, T1."""
    return align.distinctive_phrases(_pages(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "rank", F.array_join("phrase", " ").alias("phrase"))


# --- alignments made of page intervals: some pages missing, some pushed on

_ALIGN = f"""{_MAP}, al AS (SELECT conv_id, turn AS scan_page, start_offset + CASE WHEN turn % 4 = 3 THEN 600 ELSE 0 END AS pg_start, start_offset + length(page_text) + CASE WHEN turn % 4 = 3 THEN 600 ELSE 0 END AS pg_end, ((conv_id * 7 + turn * 13) % 100) / 100 AS confidence FROM page_map WHERE (conv_id + turn) % 5 <> 0)"""


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pushed = F.when(F.col("turn") % 4 == 3, 600).otherwise(0)
    own = pages.page_map(_pages(spark, sf_dir)).filter("(conv_id + turn) % 5 <> 0")
    return own.select("conv_id", F.col("turn").alias("scan_page"), (F.col("start_offset") + pushed).alias("pg_start"), (F.col("end_offset") + pushed).alias("pg_end"), (((F.col("conv_id") * 7 + F.col("turn") * 13) % 100) / 100).alias("confidence"))


@query("page_segments", f"WITH {_ALIGN}, f AS (SELECT *, CASE WHEN scan_page - lag(scan_page) OVER w <= 1 AND pg_start - lag(pg_end) OVER w > -50 AND pg_start - lag(pg_end) OVER w < 500 THEN 0 ELSE 1 END AS fresh FROM al WINDOW w AS (PARTITION BY conv_id ORDER BY scan_page)) SELECT conv_id, scan_page, sum(fresh) OVER (PARTITION BY conv_id ORDER BY scan_page)::BIGINT AS segment_id FROM f")
def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, ST8."""
    return pages.segments(_alignments(spark, sf_dir)).select("conv_id", "scan_page", "segment_id")


@query("structural_gap_groups", f"WITH {_ALIGN}, g AS (SELECT conv_id, turn FROM own WHERE (conv_id + turn) % 5 < 2), r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g) SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, run) AS run_start FROM r")
def structural_gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, W10."""
    own = pages.page_map(_pages(spark, sf_dir)).filter("(conv_id + turn) % 5 < 2").select("conv_id", "turn")
    return pages.islands(own, "conv_id", "turn")


@query("neighbor_context", f"WITH {_ALIGN} SELECT o.conv_id, o.turn, (SELECT arg_max(pg_end, scan_page) FROM al a WHERE a.conv_id = o.conv_id AND a.scan_page < o.turn) AS prev_end, (SELECT arg_min(pg_start, scan_page) FROM al a WHERE a.conv_id = o.conv_id AND a.scan_page > o.turn) AS next_start FROM own o")
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, J19."""
    own = pages.page_map(_pages(spark, sf_dir)).select("conv_id", "turn")
    al = _alignments(spark, sf_dir).withColumnRenamed("scan_page", "turn")
    return pages.neighbours(own.join(al, ["conv_id", "turn"], "left"), "conv_id", "turn").select("conv_id", "turn", "prev_end", "next_start")


@query(
    "uncovered_pages",
    f"""WITH {_ALIGN}, t AS (SELECT o.conv_id, o.turn AS page, o.page_text AS t FROM own o WHERE NOT EXISTS (SELECT 1 FROM al a WHERE a.conv_id = o.conv_id AND a.scan_page = o.turn))
    SELECT conv_id, page, len({_TOK.format(c="t")}) AS word_count, CASE WHEN len({_TOK.format(c="t")}) >= 100 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT conv_id, page, CASE WHEN length(trim(string_split(t, {NL})[1])) < 40 AND NOT regexp_matches(trim(string_split(t, {NL})[1]), '[.!?]$') THEN trim(array_to_string(string_split(t, {NL})[2:], {NL}), ' ' || {NL} || chr(9) || chr(13)) ELSE t END AS t FROM t) WHERE len({_TOK.format(c="t")}) >= 5""",
)
def uncovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, A69's first strategy, M35, without a look into the base text."""
    return gaps.uncovered(pages.page_map(_pages(spark, sf_dir)), _alignments(spark, sf_dir)).select("conv_id", "page", "word_count", "confidence")


@query("drift_regression", f"WITH {_ALIGN} SELECT conv_id, round(regr_slope(pg_start, scan_page), 4) AS slope, round(regr_intercept(pg_start, scan_page), 4) AS intercept, round(stddev_pop(pg_start), 4) AS sigma, count(*) AS n FROM al GROUP BY conv_id HAVING count(*) >= 3")
def drift_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A42's measures: the trend and spread of positions over pages."""
    return align.drift(_alignments(spark, sf_dir))


@query("alignment_sample", f"WITH {_ALIGN}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY scan_page) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM al) SELECT conv_id, scan_page FROM r WHERE i % greatest(1, n // 3) = 0")
def alignment_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-th alignment of a book."""
    return align.systematic(_alignments(spark, sf_dir), 3).select("conv_id", "scan_page")


@query("confident_alignments", f"WITH {_ALIGN}, q AS (SELECT conv_id, list_sort(list(confidence))[len(list(confidence)) // 5 + 1] AS least FROM al GROUP BY conv_id) SELECT conv_id, scan_page, confidence FROM al JOIN q USING (conv_id) WHERE confidence >= least")
def confident_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the lowest fifth."""
    return align.without_lowest_fifth(_alignments(spark, sf_dir)).select("conv_id", "scan_page", "confidence")


@query("alignment_coverage", f"WITH {_ALIGN}, s AS (SELECT conv_id, max(start_offset + length(page_text)) AS size FROM page_map GROUP BY conv_id) SELECT conv_id, count(*) AS regions, least(1.0, sum(pg_end - pg_start) / max(size)) AS coverage FROM al JOIN s USING (conv_id) GROUP BY conv_id")
def alignment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, G5."""
    size = pages.page_map(_pages(spark, sf_dir)).groupBy("conv_id").agg(F.max("end_offset").alias("size"))
    return _alignments(spark, sf_dir).join(size, "conv_id").groupBy("conv_id").agg(F.count("*").alias("regions"), F.least(F.lit(1.0), F.sum(F.col("pg_end") - F.col("pg_start")) / F.max("size")).alias("coverage"))


@query("edition_overlap", f"WITH {_ALIGN} SELECT a.conv_id, a.scan_page, m.turn AS b_page FROM al a JOIN page_map m ON a.conv_id = m.conv_id AND m.start_offset < a.pg_end AND a.pg_start < m.start_offset + length(m.page_text)")
def edition_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the other edition under each alignment."""
    m = pages.page_map(_pages(spark, sf_dir)).select("conv_id", F.col("turn").alias("b_page"), "start_offset", "end_offset")
    return pages.overlapping(_alignments(spark, sf_dir), m, "conv_id", ("pg_start", "pg_end"), ("start_offset", "end_offset")).select("conv_id", "scan_page", "b_page")


@query("global_align")
def global_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages placed in their own book, stitched."""
    return align.global_align(_pages(spark, sf_dir), pages.stitched(_pages(spark, sf_dir)))


@query("sequential_align")
def sequential_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages placed in their own book's text one after the other."""
    own = _pages(spark, sf_dir)
    return sequential.align_in_order(own, pages.stitched(own))


@query("coarse_align")
def coarse_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 to A26 between a conversation's two halves of pages and all of it."""
    half = _pages(spark, sf_dir).filter("turn % 2 = 1")
    pairs = pages.stitched(_pages(spark, sf_dir)).join(pages.stitched(half).withColumnRenamed("book_text", "other"), "conv_id")
    return align.coarse_align(pairs, "conv_id", "book_text", "other")


@query("coverage_gaps")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strategies together, with a look into the book's aligned text."""
    own = _pages(spark, sf_dir)
    base = pages.stitched(own.filter("(conv_id + turn) % 5 <> 0"))
    al = pages.page_map(own.filter("(conv_id + turn) % 5 <> 0")).select("conv_id", F.col("turn").alias("scan_page"), F.col("start_offset").alias("pg_start"), F.when(F.col("turn") % 2 == 0, (F.col("start_offset") + F.col("end_offset")) / 2).otherwise(F.col("end_offset")).cast("long").alias("pg_end"), F.lit(0.9).alias("confidence"))
    return gaps.all_gaps(pages.page_map(own), al, base)


# --- lines, headers, chapters

_LINES = f"ln AS (SELECT doc_id, unnest(string_split(text, {NL})) AS line, unnest(range(len(string_split(text, {NL})))) AS pos FROM documents)"


@query("running_headers", f"WITH l AS (SELECT conv_id, turn, trim(unnest(string_split('Book ' || conv_id % 5 || {NL} || text, {NL}))) AS line FROM conversations) SELECT conv_id, line, count(DISTINCT turn) AS n_pages FROM l WHERE line <> '' AND length(line) <= 40 GROUP BY conv_id, line HAVING count(DISTINCT turn) >= 2")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages with their book's name above."""
    own = _pages(spark, sf_dir).withColumn("text", F.concat(F.lit("Book "), (F.col("conv_id") % 5).cast("string"), F.lit("\n"), "text"))
    return pages.running_headers(own)


_CHAPTERS = f"""{_LINES}, st AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ln),
    hd AS (SELECT doc_id, trim(line) AS title, start FROM st WHERE regexp_matches(trim(line), '^(?i:chapter)\\s+([IVXLCDM]+|[0-9]+)\\b') OR (trim(line) = upper(trim(line)) AND trim(line) <> lower(trim(line)) AND length(trim(line)) BETWEEN 5 AND 60)),
    ch AS (SELECT h.doc_id, title, start, coalesce(lead(start) OVER (PARTITION BY h.doc_id ORDER BY start), length(text)) AS "end" FROM hd h JOIN documents d USING (doc_id))"""


@query("chapters", f"WITH {_CHAPTERS} SELECT * FROM ch")
def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N46, W6, W7."""
    return pages.chapters(table(spark, sf_dir, "documents"))


@query("chapter_of_offset", f"WITH {_CHAPTERS}, o AS (SELECT doc_id, length(text) // 2 AS \"offset\" FROM documents) SELECT o.doc_id, o.\"offset\", c.title FROM o LEFT JOIN ch c ON c.doc_id = o.doc_id AND o.\"offset\" >= c.start AND o.\"offset\" < c.\"end\"")
def chapter_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, J7, J8."""
    docs = table(spark, sf_dir, "documents")
    return pages.chapter_of(docs.select("doc_id", F.floor(F.length("text") / 2).cast("long").alias("offset")), pages.chapters(docs))


@query("line_width_profile", f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rk FROM ln WHERE trim(line) <> '' AND length(line) > 40), c AS (SELECT doc_id, length(line) AS width, count(*) AS n, min(pos) AS f FROM r WHERE rk <= 2000 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER w AS rk, first_value(width) OVER w AS modal FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, f)), s AS (SELECT doc_id, any_value(modal)::INT AS modal, sum(n)::BIGINT AS lines, sum(CASE WHEN abs(width - modal) <= 5 THEN n ELSE 0 END)::BIGINT AS near, (max(width) FILTER (rk <= 3) - min(width) FILTER (rk <= 3))::INT AS spread FROM k GROUP BY doc_id) SELECT *, (near / lines > 0.5 AND spread <= 5) AS preserved FROM s""")
def line_width_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15, T9."""
    return editions.line_profile(table(spark, sf_dir, "documents"))


_ENDINGS = f"""{_LINES}, en AS (SELECT doc_id, pos, lower(regexp_replace(list_last({_TOK.format(c="line")}), '[.,;:!?"'']+$', '')) AS word FROM ln WHERE trim(line) <> ''), ix AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, word FROM en WHERE word <> '')"""


@query("linebreak_match", f"""WITH {_ENDINGS}, a AS (SELECT doc_id AS a_id, doc_id + 1 AS b_id, idx, word, count(*) OVER (PARTITION BY doc_id) AS total FROM ix) SELECT a.a_id, a.b_id, any_value(a.total) AS total, count(DISTINCT CASE WHEN abs(a.idx - b.idx) <= greatest(5.0, a.total * 0.1) THEN a.idx END) AS matched FROM a LEFT JOIN ix b ON b.doc_id = a.b_id AND b.word = a.word GROUP BY a.a_id, a.b_id""")
def linebreak_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J26 between each document and the next."""
    docs = table(spark, sf_dir, "documents")
    return editions.matching_endings(docs.select(F.col("doc_id").alias("a_id"), (F.col("doc_id") + 1).alias("b_id")), editions.line_endings(docs))


@query("nearest_occurrence_line", f"""WITH w AS (SELECT doc_id, text, length(text) // 2 AS o, {_TOK.format(c="text")}[3] AS word FROM documents WHERE len({_TOK.format(c="text")}) >= 3), p AS (SELECT *, list_transform(string_split(text, word), lambda x: length(x)) AS sizes FROM w),
    q AS (SELECT doc_id, word, text, o, list_transform(range(1, len(sizes)), lambda i: list_sum(sizes[1:i]) + (i - 1) * length(word)) AS places FROM p), b AS (SELECT doc_id, word, text, list_min(list_transform(places, lambda x: abs(x - o) * 1000000000 + x)) % 1000000000 AS best FROM q) SELECT doc_id, word, best::BIGINT AS best, (length(left(text, best::INT)) - length(replace(left(text, best::INT), {NL}, '')) + 1)::BIGINT AS line FROM b""")
def nearest_occurrence_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a document's third word the occurrence nearest to its middle, and the line."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("w")).filter("size(w) >= 3").withColumn("word", F.get("w", F.lit(2)))
    own = own.withColumn("best", pages.nearest_occurrence(F.col("text"), F.col("word"), F.floor(F.length("text") / 2)))
    before = F.substring(F.col("text"), F.lit(1), F.col("best").cast("int"))
    return own.select("doc_id", "word", "best", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line"))


# --- scores




def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variorum.queries import candidates

    text = table(spark, sf_dir, "benchmark").select("item_id", "text", T.tokens(F.col("text")).alias("w"))
    own = candidates(spark, sf_dir).join(text, "item_id")
    offset = F.length(F.array_join(F.slice("w", F.lit(1), (F.col("seq") - 1).cast("int")), " ")) + F.when(F.col("seq") > 1, 1).otherwise(0)
    return own.withColumn("pg_offset", offset.cast("long")).withColumn("confidence", F.when(F.col("item_id") % 4 != 0, (F.col("item_id") % 10) / 10)).drop("w")


def _placed_sql() -> str:
    from variorum.queries import _CAND_SQL

    find = "CASE WHEN instr(region, pg_text) > 0 THEN st + instr(region, pg_text) - 1 WHEN instr(lower(region), trim(lower(pg_text))) > 0 THEN st + instr(lower(region), trim(lower(pg_text))) - 1 ELSE pg_offset END"
    x, y = (f"regexp_replace(trim(lower({c})), '[.,;:!?\"''()\\[\\]{{}}]', '', 'g')" for c in ("pg_text", "scan_text"))
    from variorum.queries import _lev

    cx, cy = (f"lower(regexp_replace(trim({c}), '^[.,;:!?\"''“”]+|[.,;:!?\"''“”]+$', '', 'g'))" for c in ("pg_text", "scan_text"))
    return f"""WITH {_CAND_SQL}, pl AS (SELECT c.item_id, seq, pg_text, scan_text, text, (length(array_to_string({_TOK.format(c="text")}[1:seq - 1], ' ')) + CASE WHEN seq > 1 THEN 1 ELSE 0 END)::BIGINT AS pg_offset, CASE WHEN c.item_id % 4 <> 0 THEN (c.item_id % 10) / 10 END AS confidence FROM cand c JOIN benchmark USING (item_id)),
    rg AS (SELECT *, greatest(0, pg_offset - 50) AS st, substring(text, greatest(0, pg_offset - 50) + 1, pg_offset + length(pg_text) + 50 - greatest(0, pg_offset - 50)) AS region FROM pl), fd AS (SELECT *, {find} AS hit FROM rg),
    cx AS (SELECT *, {_TOK.format(c="lower(substring(text, greatest(0, hit - 300) + 1, hit + length(pg_text) + 300 - greatest(0, hit - 300)))")} AS near, list_filter({_TOK.format(c="lower(scan_text)")}, lambda w: length(w) >= 3) AS ws FROM fd),
    ct AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda w: list_contains(near, w) OR list_contains(near, regexp_replace(w, '[.,;:!?"'']+$', '')))) / len(ws) END AS share FROM cx),
    pt AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0.0::DOUBLE WHEN share >= 0.8 THEN 1.0 WHEN share >= 0.6 THEN 0.8 WHEN share >= 0.4 THEN 0.5 WHEN share >= 0.2 THEN 0.3 ELSE 0.0 END AS c0, {x} AS x, {y} AS y, {cx} AS cx, {cy} AS cy FROM ct),
    pp AS (SELECT *, CASE WHEN len(list_filter({_TOK.format(c="scan_text")}, lambda w: length(w) >= 3)) <= 1 AND c0 = 0 AND length(cx) > 2 AND length(cy) > 2 AND 1 - {_lev("cx", "cy")} / greatest(length(cx), length(cy)) >= 0.5 THEN 0.5::DOUBLE ELSE c0 END AS c,
      CASE WHEN x = '' OR y = '' THEN 0.0 WHEN len({_TOK.format(c="x")}) = 1 AND len({_TOK.format(c="y")}) = 1 THEN CASE WHEN {_lev("x", "y")} = 0 THEN 1.0 WHEN {_lev("x", "y")} / greatest(length(x), length(y)) <= 0.2 THEN 0.9 WHEN {_lev("x", "y")} / greatest(length(x), length(y)) <= 0.4 THEN 0.7 WHEN {_lev("x", "y")} / greatest(length(x), length(y)) <= 0.6 THEN 0.4 ELSE 0.1 END END AS e,
      CASE WHEN confidence IS NULL THEN 0.3 WHEN confidence >= 0.9 THEN 1.0 WHEN confidence >= 0.7 THEN 0.8 WHEN confidence >= 0.5 THEN 0.5 ELSE 0.2 END AS al, least(length(trim(pg_text)), length(trim(scan_text))) / greatest(length(trim(pg_text)), length(trim(scan_text))) AS lr FROM pt),
    scored AS (SELECT item_id, seq, pg_offset, pg_text, scan_text, c::DOUBLE * 0.45::DOUBLE + e::DOUBLE * 0.2::DOUBLE + al::DOUBLE * 0.2::DOUBLE + (CASE WHEN length(trim(pg_text)) = 0 OR length(trim(scan_text)) = 0 THEN 0.3 WHEN lr >= 0.8 THEN 1.0 WHEN lr >= 0.6 THEN 0.7 WHEN lr >= 0.4 THEN 0.4 ELSE 0.1 END)::DOUBLE * 0.15::DOUBLE AS score FROM pp WHERE e IS NOT NULL)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = score.with_score(_placed(spark, sf_dir), "text", "pg_offset", "confidence")
    return own.filter("score is not null").select("item_id", "seq", "pg_offset", "pg_text", "scan_text", "score")


@query("error_scores")
def error_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M5 to M10, of single-word pairs."""
    return _scored(spark, sf_dir).select("item_id", "seq", F.round("score", 6).alias("score"))


@query("confidence_buckets")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return score.buckets(_scored(spark, sf_dir).withColumn("score", F.round("score", 6)))


@query("best_at_offset")
def best_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11's first half, over 40-character bins of the offsets."""
    binned = _scored(spark, sf_dir).withColumn("score", F.round("score", 6)).withColumn("bin", F.floor(F.col("pg_offset") / 40).cast("long"))
    return score.dedup_exact(binned, ["item_id"], "bin").select("item_id", "bin", "seq")


@query("near_repetitions")
def near_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11's second half."""
    return score.dedup_near(_scored(spark, sf_dir), ["item_id"]).select("item_id", "seq", "pg_offset")


@query("per_page_stats")
def per_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G25."""
    return score.page_stats(_scored(spark, sf_dir))


@query("top_noisy_pages")
def top_noisy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7."""
    return score.noisiest(_scored(spark, sf_dir))


@query("global_replacements")
def global_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9, T2, J22."""
    from variorum.queries import candidates

    words = table(spark, sf_dir, "benchmark").select(F.explode(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda x: x != "")).alias("word"))
    return score.global_replacements(candidates(spark, sf_dir), words)


def register_scores() -> None:
    base = _placed_sql()
    SQL["review_report"] = _judged_sql()
    SQL["error_scores"] = f"{base} SELECT item_id, seq, round(score, 6) AS score FROM scored"
    SQL["confidence_buckets"] = f"{base} SELECT count(*) FILTER (round(score, 6) >= 0.8) AS high, count(*) FILTER (round(score, 6) >= 0.5 AND round(score, 6) < 0.8) AS medium, count(*) FILTER (round(score, 6) < 0.5) AS low FROM scored"
    SQL["best_at_offset"] = f"{base} SELECT item_id, pg_offset // 40 AS bin, seq FROM scored QUALIFY row_number() OVER (PARTITION BY item_id, pg_offset // 40 ORDER BY round(score, 6) DESC, seq) = 1"
    SQL["near_repetitions"] = base.replace("WITH ", "WITH RECURSIVE ", 1) + """, nr AS (SELECT item_id, seq, pg_offset, pg_text, scan_text, row_number() OVER (PARTITION BY item_id, pg_text, scan_text ORDER BY pg_offset, seq) AS n FROM scored),
    kept AS (SELECT *, pg_offset AS last, TRUE AS keep FROM nr WHERE n = 1 UNION ALL SELECT r.*, CASE WHEN r.pg_offset - k.last >= 50 THEN r.pg_offset ELSE k.last END, r.pg_offset - k.last >= 50 FROM kept k JOIN nr r ON r.item_id = k.item_id AND r.pg_text = k.pg_text AND r.scan_text = k.scan_text AND r.n = k.n + 1)
    SELECT item_id, seq, pg_offset FROM kept WHERE keep"""
    SQL["per_page_stats"] = f"{base}, per AS (SELECT item_id, count(*) AS n FROM scored GROUP BY item_id) SELECT sum(n)::BIGINT AS total, count(*) AS pages, avg(n) AS average, list_sort(list(n))[count(*) // 2 + 1] AS median, max(n) AS most FROM per"
    SQL["top_noisy_pages"] = f"{base} SELECT item_id, count(*) AS n FROM scored GROUP BY item_id ORDER BY n DESC, item_id LIMIT 10"


# --- editions

_META = [
    ("Harper & Brothers", "1884", "The Adventures of Tom: A Story", "New York", True, "HARPER & BROTHERS.", "1885", "Adventures of Tom", "New York", "A first edition copy"),
    ("Macmillan", "1901", "A Book", "London", False, "Scribner", "1920", "Another Thing Entirely", "Boston", ""),
    ("", "", "The Same Title", "", False, "", "", "Same Title", "", ""),
    ("The Clarendon Press,", "published 1870", "Poems", "Oxford", False, "clarendon press", "c1871", "Poems; with notes", "oxford, england", "first edition"),
    (None, "1850", None, None, None, None, "1851", "X", None, None),
    ("Chapman", "1850", "Bleak House", "London", True, "Chapman and Hall", "1853", "Bleak House, a novel", "London", "First Edition, in parts"),
]
_META_COLS = "pg_publisher string, pg_year string, pg_title string, pg_city string, pg_first boolean, ia_publisher string, ia_date string, ia_title string, ia_city string, ia_description string"


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


def _publisher_sql(c: str) -> str:
    for p in ("the ", "and ", "& "):
        c = f"(CASE WHEN starts_with({c}, '{p}') THEN substring({c}, {len(p) + 1}) ELSE {c} END)"
    return f"trim(regexp_replace(regexp_replace({c}, '[.,]+$', ''), '\\s+', ' ', 'g'))"


def _title_sql(c: str) -> str:
    c = f"trim(lower(string_split_regex({c}, '(?i)[:;]\\s*|--|,\\s+(?:a |an |the )')[1]))"
    for p in ("the ", "a ", "an "):
        c = f"(CASE WHEN starts_with({c}, '{p}') THEN substring({c}, {len(p) + 1}) ELSE {c} END)"
    return f"list_distinct({_TOK.format(c=c)})"


_META_SQL = f"""WITH m AS (SELECT id, {", ".join(f"coalesce({c.split()[0]}, {'FALSE' if c.endswith('boolean') else chr(39) * 2}) AS {c.split()[0]}" for c in _META_COLS.split(", "))} FROM (VALUES {", ".join("(" + str(i) + ", " + ", ".join(map(_value, r)) + ")" for i, r in enumerate(_META))}) v(id, {", ".join(c.split()[0] for c in _META_COLS.split(", "))})),
    n AS (SELECT *, {_publisher_sql("trim(lower(pg_publisher))")} AS pp, {_publisher_sql("trim(lower(ia_publisher))")} AS ip, try_cast(regexp_extract(pg_year, '([0-9]{{4}})', 1) AS INT) AS py, try_cast(regexp_extract(ia_date, '([0-9]{{4}})', 1) AS INT) AS iy, {_title_sql("pg_title")} AS pt, {_title_sql("ia_title")} AS it, trim(lower(pg_city)) AS pc, trim(lower(ia_city)) AS ic FROM m),
    s AS (SELECT id, (CASE WHEN pp <> '' AND ip <> '' AND (contains(pp, ip) OR contains(ip, pp)) THEN 40 ELSE 0 END) + (CASE WHEN abs(py - iy) <= 2 THEN 30 ELSE 0 END) + (CASE WHEN len(pt) > 0 AND len(it) > 0 AND len(list_intersect(pt, it)) / len(list_distinct(list_concat(pt, it))) > 0.7 THEN 10 ELSE 0 END)
      + (CASE WHEN pc <> '' AND ic <> '' AND (contains(pc, ic) OR contains(ic, pc)) THEN 10 ELSE 0 END) + (CASE WHEN pg_first AND contains(lower(ia_description), 'first edition') THEN 10 ELSE 0 END) AS score, (trim(pg_publisher) <> '' AND trim(ia_publisher) <> '') OR (py IS NOT NULL AND iy IS NOT NULL) AS known FROM n)
    SELECT id, score, CASE WHEN score = 0 OR NOT known THEN 'unable_to_determine' WHEN score >= 70 THEN 'match' WHEN score >= 40 THEN 'possible' ELSE 'mismatch' END AS result FROM s"""


@query("metadata_score", _META_SQL)
def metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19, M39's fields, N40 to N42."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_META)], f"id int, {_META_COLS}")
    return editions.metadata_score(rows).select("id", "score", "result")


_STATES = ("match", "mismatch", "possible", "unable_to_determine", None)
_VERDICT_SQL = f"""WITH a(a, s) AS (VALUES {", ".join(f"({_value(x)}, {s})" for x in _STATES for s in (20, 90))}), b(b, c) AS (VALUES {", ".join(f"({_value(x)}, {c}::DOUBLE)" for x in _STATES for c in (0.3, 0.95))}), r AS (SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a END AS lone FROM a, b)
    SELECT coalesce(a, '') AS a, s, coalesce(b, '') AS b, c, CASE WHEN a IS NULL OR b IS NULL THEN CASE WHEN lone IN ('match', 'mismatch') THEN lone ELSE 'unable_to_determine' END WHEN a IN ('match', 'mismatch') THEN a WHEN b IN ('match', 'mismatch') THEN b ELSE 'unable_to_determine' END AS result,
    CASE WHEN a IS NULL AND b IS NULL THEN 0.0 WHEN lone IS NOT NULL THEN CASE WHEN lone IN ('match', 'mismatch') THEN 0.5 ELSE 0.0 END WHEN a = 'match' AND b = 'match' THEN greatest(0.8::DOUBLE, (s / 100.0::DOUBLE + c) / 2) WHEN a = 'mismatch' AND b = 'mismatch' THEN greatest(0.6::DOUBLE, s / 100.0::DOUBLE, c)
      WHEN b IN ('match', 'mismatch') AND a = 'unable_to_determine' THEN c WHEN a IN ('match', 'mismatch') AND b = 'unable_to_determine' THEN s / 100.0::DOUBLE WHEN a IN ('match', 'mismatch') OR b IN ('match', 'mismatch') THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM r"""


@query("edition_verdict", _VERDICT_SQL)
def edition_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases of the two approaches."""
    rows = spark.createDataFrame([(x, s, y, c) for x in _STATES for s in (20, 90) for y in _STATES for c in (0.3, 0.95)], "a string, s int, b string, c double")
    result, confidence = editions.overall(F.col("a"), F.col("s"), F.col("b"), F.col("c"))
    return rows.select(F.coalesce("a", F.lit("")).alias("a"), "s", F.coalesce("b", F.lit("")).alias("b"), "c", result.alias("result"), confidence.alias("confidence"))


# --- sources

_BODY_SQL = "trim(regexp_replace(regexp_replace(html, '(?is)<(script|style|head)\\b.*?</(script|style|head)>|<!--.*?-->', '', 'g'), '(?i)<(p|div|h[1-6]|li|ul|nav|article|footer|br|tr|td|table|blockquote)\\b[^>]*>', chr(10), 'g'))"


@query("paragraphs_html", f"WITH b AS (SELECT page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(regexp_replace({_BODY_SQL}, '<[^>]+>', '', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM pages) SELECT page_id, len(p) AS n_paragraphs, md5(array_to_string(p, chr(10) || chr(10))) AS body_md5 FROM b")
def paragraphs_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native path."""
    own = table(spark, sf_dir, "pages").select("page_id", web.paragraphs(F.col("html")).alias("p"))
    return own.select("page_id", F.size("p").cast("long").alias("n_paragraphs"), F.md5(F.array_join("p", "\n\n")).alias("body_md5"))


@query("html_metadata", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS heading, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(regexp_extract(html, '(?i)<html[^>]*\\blang=[\"'']?([a-z]+)', 1)) AS lang, coalesce(nullif(regexp_extract(url, '([0-9]+)', 1), ''), '0')::BIGINT AS book_id FROM pages")
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, S6."""
    return web.metadata(table(spark, sf_dir, "pages"))


@query("title_slugs", "WITH s AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages) SELECT page_id, CASE WHEN length(s) <= 30 THEN s ELSE regexp_replace(left(s, 30), '-[^-]*$', '') END AS slug FROM s")
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N35."""
    return web.metadata(table(spark, sf_dir, "pages")).select("page_id", T.slug(F.col("title"), 30).alias("slug"))


# --- logs and streams


@query("results_upsert", "SELECT user_id, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS event_type FROM events GROUP BY user_id")
def results_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J29, S27, ST2."""
    return stream.upsert(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")).select("user_id", "event_id", "event_type")


@query("completed_sync", "WITH o AS (SELECT user_id, max(event_id) AS old_id FROM events WHERE event_id % 2 = 0 GROUP BY user_id), n AS (SELECT user_id, max(event_id) AS new_id FROM events WHERE event_id % 3 = 0 GROUP BY user_id) SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(new_id, old_id) AS event_id, new_id IS NOT NULL AND old_id IS NOT NULL AS updated FROM o FULL JOIN n ON o.user_id = n.user_id")
def completed_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J30."""
    e = table(spark, sf_dir, "events")
    old, new = (e.filter(f"event_id % {k} = 0").groupBy("user_id").agg(F.max("event_id").alias(name)) for k, name in ((2, "old_id"), (3, "new_id")))
    both = old.join(new, "user_id", "full")
    return both.select("user_id", F.coalesce("new_id", "old_id").alias("event_id"), (F.col("new_id").isNotNull() & F.col("old_id").isNotNull()).alias("updated"))


@query("queue_exclusions", "SELECT c_custkey FROM customer c WHERE c_mktsegment <> 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def queue_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue without what is done; customers stand for books, finished orders for the done list."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("rolling_monitor", "SELECT event_id, user_id, count(value) OVER w AS seen, coalesce(count(value) OVER w >= 5 AND value < avg(value) OVER w * 0.8, FALSE) AS regressed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def rolling_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7, W5, F29."""
    return stream.monitor(table(spark, sf_dir, "events"))


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(*) FILTER (value > 0) AS positive FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 in tumbling windows, drained."""
    return stream.drain(stream.tumbling(stream.source(spark, sf_dir)), "complete")


@query("stream_session", "WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8 as session windows, drained."""
    return stream.drain(stream.sessions(stream.source(spark, sf_dir)), "complete")


@query("stream_dedup", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: each row of the log once."""
    return stream.drain(stream.first_rows(stream.source(spark, sf_dir)).select("event_id", "user_id", "event_type"), "append")


# --- whole plans, over near copies: each text as the page of a book, its likest smaller one


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, their pages, and (book_id, a_id): each text with a likest smaller one is a page of a book of that text."""
    pairs = cut(nearest_pairs(table(spark, sf_dir, "documents")))
    key = F.col("b_id").alias("book_id")
    return pairs.select(key, F.col("a_text").alias("body_text")), pairs.select(key, F.lit(0).cast("long").alias("page_num"), F.col("b_text").alias("text")), pairs.select(key, "a_id")


def _named(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with the smaller text's id as a_id; book_id is the larger one's."""
    return found.join(ids, "book_id").select("a_id", *found.columns)


@query("errata_errors")
def errata_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errata plan's errors."""
    books, own, ids = _near(spark, sf_dir)
    return _named(errata.run(books, own).errors, ids)


@query("edition_variants")
def edition_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the comparison plan's variants."""
    books, own, ids = _near(spark, sf_dir)
    return _named(compare.run(books, own), ids)


@query("edition_line_breaks")
def edition_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks of near copies against each other."""
    books, own, ids = _near(spark, sf_dir)
    return _named(verify.line_breaks(books.withColumnRenamed("body_text", "text"), own.select("book_id", "text")), ids)


# --- dictionary, anchors, body


def _forms(w: str) -> str:
    n = f"length({w})"

    def cut(k: int, add: str = "") -> str:
        return f"left({w}, {n} - {k})" + (f" || '{add}'" if add else "")

    def single(k: int) -> str:
        return f"CASE WHEN {n} - {k} > 2 AND right({cut(k)}, 1) = left(right({cut(k)}, 2), 1) THEN left({w}, {n} - {k + 1}) END"

    rules = [(5, "regexp_matches({w}, '(ing|ed)ly$')", [cut(2), cut(4)]), (5, "ends_with({w}, 'ing')", [cut(3), single(3)]), (4, "ends_with({w}, 'ed')", [cut(2), single(2), cut(2, "e")]), (4, "ends_with({w}, 'ly')", [cut(2)]), (4, "ends_with({w}, 'er')", [cut(2)]), (4, "ends_with({w}, 'est')", [cut(3)]), (3, "ends_with({w}, 's') AND NOT ends_with({w}, 'ss')", [cut(1)]), (4, "ends_with({w}, 'es')", [cut(2), cut(2, "y")])]
    parts = [f"CASE WHEN {n} > {least} AND {test.format(w=w)} THEN [{', '.join(forms)}] ELSE [] END" for least, test, forms in rules]
    return f"list_filter(flatten([[{w}], {', '.join(parts)}]), lambda x: x IS NOT NULL AND x <> '')"


_PLAIN_WORDS = "(SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: regexp_matches(x, '^[a-z]+$'))) AS word FROM {t})"


@query("dictionary_lookup", f"WITH d AS (SELECT word AS entry FROM {_PLAIN_WORDS.format(t='benchmark')}), w AS (SELECT word FROM {_PLAIN_WORDS.format(t='documents')}), f AS (SELECT word, unnest({_forms('word')}) AS entry FROM w), k AS (SELECT DISTINCT word FROM f SEMI JOIN d ON d.entry = f.entry) SELECT w.word, k.word IS NOT NULL AS in_dictionary FROM w LEFT JOIN k ON k.word = w.word")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words of ASCII letters against those of the benchmark."""

    def words(name: str) -> DataFrame:
        # a text's words are made distinct before they are tested and leave it
        return table(spark, sf_dir, name).select(F.explode(F.filter(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda x: x.rlike("^[a-z]+$"))).alias("word")).distinct()

    return dictionary.in_dictionary(cut(words("documents")), words("benchmark").withColumnRenamed("word", "entry"))


@query("body_starts")
def body_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A48."""
    return table(spark, sf_dir, "documents").select("doc_id", anchors.body_start(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("start"))


@query("page_places")
def page_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31 to A33."""
    return anchors.place_pages(_pages(spark, sf_dir), pages.stitched(_pages(spark, sf_dir)))


@query("tracked_pages")
def tracked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST6, A49 to A55."""
    al = _alignments(spark, sf_dir).select(F.col("conv_id").alias("book_id"), F.col("scan_page").alias("page_num"), "pg_end", "confidence")
    return tracker.track(al)


# --- stitched differences, file lines, verifier's answers


@query("stitched_errors")
def stitched_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a book, its pages with some words misread."""
    own = _pages(spark, sf_dir)
    books = pages.stitched(own).select(F.col("conv_id").alias("book_id"), F.col("book_text").alias("body_text"))
    misread = F.regexp_replace(F.regexp_replace("text", r"\bthe\b", "tbe"), r"\bof ", "")
    scans = own.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_num"), misread.alias("text"))
    al = _alignments(spark, sf_dir).withColumnRenamed("conv_id", "book_id")
    return stitched.candidates(books, al, scans).drop("diff_description")


_CLEAN_LINE = "trim(regexp_replace(" + "{replaced}" + ", '\\s+', ' ', 'g'))"


def _clean_line_sql(c: str) -> str:
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for name, sign in (("ldquo", '"'), ("rdquo", '"'), ("lsquo", "''"), ("rsquo", "''"), ("mdash", "-"), ("ndash", "-"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{sign}')"
    return _CLEAN_LINE.format(replaced=c)


#: a passage of each page: four words from the seventh on, which may run over several lines
_ASKED = f"""l AS (SELECT page_id, list_transform(string_split_regex(html, '\r\n|\n|\r'), lambda x: {_clean_line_sql("x")}) AS lines FROM pages),
    w AS (SELECT page_id, lines, list_filter(string_split(array_to_string(lines, ' '), ' '), lambda x: x <> '') AS w FROM l), a AS (SELECT page_id, lines, array_to_string(w[7:10], ' ') AS passage FROM w WHERE len(w) >= 10)"""
_FOUND = f"""{_ASKED}, e AS (SELECT page_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM a),
    one AS (SELECT e.page_id, min(n) AS n FROM e JOIN a USING (page_id) WHERE contains(line, passage) GROUP BY e.page_id),
    runs AS (SELECT a.page_id, s.size, n.n, array_to_string(list_filter(lines[n.n:n.n + s.size - 1], lambda x: x <> ''), ' ') AS text, passage FROM a, (SELECT unnest(range(2, 7)) AS size) s, (SELECT unnest(range(1, (SELECT max(len(lines)) FROM a) + 1)) AS n) n WHERE n.n <= len(lines) - s.size + 1),
    several AS (SELECT page_id, arg_min(n, size * 1000000 + n) AS n FROM runs WHERE contains(text, passage) GROUP BY page_id),
    found AS (SELECT a.page_id, passage, coalesce(one.n, several.n, 0) AS pg_file_line FROM a LEFT JOIN one USING (page_id) LEFT JOIN several USING (page_id))"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "pages").select("page_id", locate.file_lines(F.col("html")).alias("lines"))
    words = F.filter(F.split(F.array_join("lines", " "), " "), lambda x: x != "")
    return own.select("page_id", words.alias("w")).filter("size(w) >= 10").select("page_id", F.array_join(F.slice("w", 7, 4), " ").alias("passage"))


@query("file_lines", f"WITH {_FOUND} SELECT * FROM found")
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of its page's source where a passage begins."""
    return locate.with_lines(_asked(spark, sf_dir), table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "passage")


@query("line_contexts", f"""WITH {_FOUND}, near AS (SELECT f.page_id, pg_file_line, n, 'Line ' || n || ': ' || line || CASE WHEN n = pg_file_line THEN '  <-- error here' ELSE '' END AS said FROM found f JOIN e ON e.page_id = f.page_id AND abs(n - pg_file_line) <= 1 WHERE pg_file_line > 0 AND line <> ''),
    said AS (SELECT page_id, string_agg(said, chr(10) ORDER BY n) AS context FROM near GROUP BY page_id) SELECT f.page_id, pg_file_line, md5(coalesce(context, '')) AS context_md5 FROM found f LEFT JOIN said USING (page_id)""")
def line_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M57, M59."""
    files = table(spark, sf_dir, "pages").select("page_id", "html")
    told = locate.line_context(file_lines(spark, sf_dir), files, "page_id")
    return told.select("page_id", "pg_file_line", F.md5("context").alias("context_md5"))


@query("verifier_verdicts")
def verifier_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as items, ten a batch, and replies made of them, whole, fenced, broken and missing."""
    from variorum.queries import candidates

    rows = candidates(spark, sf_dir).withColumns({"batch_id": F.col("item_id") * 100 + F.floor(F.col("seq") / 10), "item": F.pmod("seq", F.lit(10))})
    answers = F.filter(F.array_sort(F.collect_list(F.struct(F.col("item").alias("index"), F.col("scan_text").alias("transcription"), F.lit("around it").alias("image_evidence"), (F.col("seq") % 7 == 0).alias("unable_to_verify")))), lambda x: x["index"] != 3)
    replies = rows.groupBy("batch_id").agg(F.to_json(answers).alias("said"))
    k = F.pmod("batch_id", F.lit(5))
    replies = replies.select("batch_id", F.when(k == 1, F.concat(F.lit("Here:\n```json\n"), "said", F.lit("\n```"))).when(k == 2, "[no").when(k == 3, F.lit(None)).otherwise(F.col("said")).alias("reply"))
    return verifier.batch_verdicts(rows, replies).select("item_id", "seq", "verdict", "confidence", "reasoning", "suggested_fix")


# --- reports

_JUDGED = "element_at(array('scan_correct', 'edition_variant', 'ambiguous', 'pg_correct', 'unable_to_verify', 'intentional_modernization', 'scan_correct'), cast(seq % 7 as int) + 1)"


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates as judged errors of ten books, and these books."""
    from variorum.queries import candidates

    rows = candidates(spark, sf_dir).select(
        (F.pmod("item_id", F.lit(10))).alias("book_id"), (F.col("item_id") * 1000 + F.col("seq")).alias("seq"), "pg_text", "scan_text", F.expr(_JUDGED).alias("verdict"), ((F.col("seq") % 11) / 10).alias("confidence"),
        F.when(F.col("seq") % 13 == 0, "alignment_artifact").when(F.col("seq") % 5 == 0, "edition_variant").otherwise("wrong_word").alias("category"), (F.col("seq") % 3).alias("pg_file_line"), (F.col("item_id") % 40 + 7).alias("scan_page"),
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("Chapter "), (F.col("seq") % 6).cast("string"))).alias("chapter_title"), F.when(F.col("seq") % 2 == 0, "read so").alias("reasoning"), F.lit("scan1").alias("scan_id"),
    )
    books = spark.range(10).select(F.col("id").alias("book_id"), F.concat(F.lit("Book "), F.col("id").cast("string")).alias("title"), F.lit("N. N.").alias("author"), F.lit("scan1").alias("scan_source"), F.lit(40).alias("pages_checked"), F.lit(50).alias("total_pages"), F.lit(0.8).alias("coverage"))
    return rows, books


def _judged_sql() -> str:
    from variorum.queries import _CAND_SQL

    marks = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in markdown.REVIEW.items())
    todo = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in markdown.REVIEW.items())
    return f"""WITH {_CAND_SQL}, e AS (SELECT ((item_id % 10) + 10) % 10 AS book_id, item_id * 1000 + seq AS seq, pg_text, scan_text, ['scan_correct', 'edition_variant', 'ambiguous', 'pg_correct', 'unable_to_verify', 'intentional_modernization', 'scan_correct'][seq % 7 + 1] AS verdict, (seq % 11) / 10 AS confidence,
      CASE WHEN seq % 13 = 0 THEN 'alignment_artifact' WHEN seq % 5 = 0 THEN 'edition_variant' ELSE 'wrong_word' END AS category, seq % 3 AS line, item_id % 40 + 7 AS page, CASE WHEN seq % 4 = 0 THEN 'Chapter ' || seq % 6 ELSE '' END AS chapter, CASE WHEN seq % 2 = 0 THEN 'read so' ELSE '' END AS reasoning FROM cand),
    r AS (SELECT * FROM e WHERE category <> 'alignment_artifact' AND NOT (verdict = 'scan_correct' AND confidence >= 0.8 AND line > 0)), b AS (SELECT unnest(range(10)) AS book_id), c AS (SELECT b.book_id, count(r.seq) AS items FROM b LEFT JOIN r USING (book_id) GROUP BY b.book_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seq) AS n FROM r WHERE verdict <> 'scan_correct' OR confidence < 0.8),
    lines AS (SELECT book_id, 0 AS section, 0::BIGINT AS n, 'Quality Audit Review Items: Book ' || book_id || ' (PG #' || book_id || ')' || chr(10) || chr(10) || CASE WHEN items = 0 THEN '0 items need review - errata_email.txt is ready to submit.' ELSE items || ' items need your decision before submission' || chr(10) || '---' || chr(10) END AS text FROM c
      UNION ALL SELECT book_id, 1, n, CASE verdict {marks} END || ' ' || CASE WHEN line > 0 THEN 'Line ' || line || ', ' ELSE '' END || 'Page ' || page || CASE WHEN chapter <> '' THEN ', (' || chapter || ')' ELSE '' END || chr(10) || '    PG text: ' || regexp_replace(pg_text, '<[^>]+>', '', 'g') || chr(10) || '    Scan text: ' || regexp_replace(scan_text, '<[^>]+>', '', 'g')
        || chr(10) || '    Verdict: ' || verdict || ' (' || round(confidence * 100)::BIGINT || '%)' || CASE WHEN reasoning <> '' THEN chr(10) || '    Reasoning: ' || reasoning ELSE '' END || chr(10) || '    Action needed: ' || CASE verdict {todo} END || chr(10) || '    Scan page: https://archive.org/details/scan1/page/n' || page || '/mode/1up' || chr(10) FROM t)
    SELECT book_id, section, n, md5(text) AS text_md5 FROM lines"""


@query("review_report")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M61, F49 to F53."""
    errors, books = _judged(spark, sf_dir)
    return markdown.review_lines(errors, books).select("book_id", "section", "n", F.md5("text").alias("text_md5"))


@query("audit_report")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of ten books as texts."""
    errors, books = _judged(spark, sf_dir)
    return markdown.document(markdown.audit_lines(errors, books))


@query("gap_report")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps of coverage_gaps as lines."""
    own = _pages(spark, sf_dir).select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_num"), "text")
    kept = own.filter("(book_id + page_num) % 5 <> 0")
    base = pages.stitched(kept, "book_id", "page_num")
    al = pages.page_map(kept, "book_id", "page_num").select("book_id", F.col("page_num").alias("scan_page"), F.col("start_offset").alias("pg_start"), F.col("end_offset").alias("pg_end"), F.lit(0.9).alias("confidence"))
    found = cut(gaps.all_gaps(pages.page_map(own, "book_id", "page_num"), al, base, "book_id", "page_num"))
    return markdown.gap_lines(found, own, al, base.withColumnRenamed("book_text", "body_text"))


@query("comparison_report")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M74, T6, T11."""
    from variorum.queries import variant_classification

    rows = variant_classification(spark, sf_dir).select(F.pmod("item_id", F.lit(10)).alias("book_id"), F.col("item_id").alias("b_page"), "seq", "variant", "significance", F.lit(0.9).alias("confidence"), F.concat(F.lit("a"), F.col("seq").cast("string")).alias("pg_text"), F.lit("b").alias("scan_text"))
    return markdown.comparison_report(rows)



# --- exports and batches


@query("edition_info", f"""WITH t AS (SELECT page_id, html, substring(html, greatest(strpos(html, '{exports.START}'), 1)::INT, {exports.BODY}) AS body FROM pages) SELECT page_id, coalesce({", ".join(f"nullif(trim(regexp_extract(body, '(?i){p}', 1)), '')" for p in exports.YEARS)}) AS year,
    coalesce({", ".join(f"nullif(trim(regexp_extract(left(body, {exports.FRONT}), '{p}', 1)), '')" for p in exports.PUBLISHERS)}) AS publisher, nullif(left(trim(regexp_extract(left(html, {exports.HEAD}), 'Produced by\\s+(.+?)(?:\\n|$)', 1)), 200), '') AS transcriber_notes FROM t""")
def edition_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F61 over page sources as books."""
    return table(spark, sf_dir, "pages").select("page_id", exports.edition_info(F.col("html")).alias("i")).select("page_id", "i.year", "i.publisher", "i.transcriber_notes")


@query("work_queue", "WITH b AS (SELECT c_custkey AS book_id, c_acctbal AS rank, CASE WHEN c_custkey % 3 = 0 THEN 'german' ELSE 'english' END AS language, CASE WHEN c_custkey % 5 <> 0 THEN 'scan' || c_custkey END AS scan_id FROM customer), q AS (SELECT * FROM b WHERE language = 'english' AND scan_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o_custkey = book_id AND o_orderstatus = 'F') AND book_id % 7 <> 0) SELECT book_id, scan_id FROM q ORDER BY rank, book_id LIMIT 50 OFFSET 10")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as books, those with a finished order as done; the queue's second lot of fifty at the tenth place."""
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_acctbal").alias("rank"), F.when(F.col("c_custkey") % 3 == 0, "german").otherwise("english").alias("language"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("scan"), F.col("c_custkey").cast("string"))).alias("scan_id"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("book_id"))
    skip = books.filter("book_id % 7 = 0").select("book_id", F.lit("anthology").alias("reason"))
    return exports.work_queue(books, done, skip, 10, 50)[0].select("book_id", "scan_id")


@query("category_changes", "WITH a AS (SELECT event_type AS category, count(*) AS n FROM events WHERE event_id % 2 = 0 AND value > 0 GROUP BY 1), b AS (SELECT event_type AS category, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.category, b.category) AS category, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.category = b.category")
def category_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as categories, of two halves of the log."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "category")
    a, b = (x.groupBy("category").agg(F.count("*").alias("n")) for x in (e.filter("event_id % 2 = 0 and value > 0"), e.filter("event_id % 2 = 1")))
    return exports.compare_counts(a, b)


@query("text_chunks")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N8."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(exports.text_chunks(F.col("text"))).alias("seq", "chunk"))
    return own.select("doc_id", "seq", "chunk")


@query("report_json")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S57, S60 to S63."""
    return exports.report_json(*_judged(spark, sf_dir))


@query("recurring_pairs")
def recurring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G24, N43."""
    return exports.recurring(_judged(spark, sf_dir)[0])[0]

"""The registered collation queries, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum.functions import lexicon
from variorum.functions import text as T
from variorum.operators import diff, rules, variants
from variorum.operators.pairs import linked_classes, nearest_pairs
from variorum.registry import QUERIES, SQL, Query, query
from variorum.runtime import table

__all__ = ["QUERIES", "SQL"]

# --- candidates: examples of each rule, and words of the benchmark with their variations

EXAMPLES = [
    ("--", "—"), ('"', "“"), ("’tis", "'tis"), ("it is", "'tis"), ("some one", "someone"), ("to-day", "today"),
    ("colour", "color"), ("the colour of it", "the color of it"), ("centre", "center"), ("theatre", "theater"), ("grey", "gray"),
    ("hello,", "hello"), ("some- thing", "something"), ("thing", "(absent in scan)"), ("(absent in PG)", "extra words here"),
    ("tne", "the"), ("someone", "some one"), ("approxmately", "approximately"), ("J.B. Smith", "J.B Smith"), ("a; b", "a: b"),
    ("cathedral", "breakfast"), ("ning", "morning"), ("he said (1)", "he said *"), ("<div>x</div>", "x"), ("Chapter One", "CHAPTER ONE"),
    ("\"He", "\"He went to the river and never came back"), ("he did not go", "he did go"), ("the old man went", "a young man ran"),
    ("apologised", "apologized"), ("travelled far", "traveled far"), ("cats", "cat"), ("dishes", "dish"), ("word ;", "word;"),
    ("one two three four five six seven eight nine ten eleven", "one"), ("{43}", "word"), ("le.", "unreasonable."), ("upon", "on"), ("", "gap"), ("boss's", "bos"),
]

_MUTATIONS = {0: "translate({w}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')", 1: "concat({w}, 's')", 2: "concat({w}, ';')", 3: "translate({w}, 'eo', 'oe')", 4: "{next}", 5: "concat('\"', {w}, '\"')", 6: "substring({w}, 2)", 7: "concat({w}, ' ', {next})"}
_CASE = "CASE {i} % 9 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _MUTATIONS.items()) + " ELSE concat({w}, 'x') END"


def _quote(s: str) -> str:
    return s.replace("'", "''")


_WORDS_SQL = r"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"
_CAND_SQL = f"""
    words AS (SELECT item_id, {_WORDS_SQL.format(c="text")} AS w FROM benchmark),
    placed AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM words),
    cand AS (
      SELECT item_id, i AS seq, w[i] AS pg_text, {_CASE.format(i="i", w="w[i]", next="w[i + 1]")} AS scan_text FROM placed
      UNION ALL SELECT * FROM (VALUES {", ".join(f"(-1::BIGINT, {k}::BIGINT, '{_quote(a)}', '{_quote(b)}')" for k, (a, b) in enumerate(EXAMPLES, 1))}) e(item_id, seq, pg_text, scan_text)
    )"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("w"))
    placed = words.select("item_id", "w", F.posexplode("w").alias("p", "x")).withColumn("i", F.col("p") + 1).filter("i < size(w)")
    made = placed.select("item_id", F.col("i").cast("long").alias("seq"), F.expr("get(w, i - 1)").alias("pg_text"), F.expr(_CASE.format(i="i", w="get(w, i - 1)", next="get(w, i)")).alias("scan_text"))
    own = spark.createDataFrame([(-1, k, a, b) for k, (a, b) in enumerate(EXAMPLES, 1)], "item_id long, seq long, pg_text string, scan_text string")
    return made.unionByName(own)


W_SQL, NW_SQL = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_\s]"


def _sub(c: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{_quote(pattern)}', '{by}', 'g')"
    return c


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _norm_diff(c: str) -> str:
    return _squeeze(_sub(c, (r"_([^_]+)_", r"\1"), (r"\[[0-9]+\]", "FOOTNOTE"), (r"[¹²³⁴⁵⁶⁷⁸⁹⁰]+", "FOOTNOTE"), (rf"({W_SQL})-\s+", r"\1")))


# --- normalisation and tokens


@query("norm_tokens", f"SELECT doc_id, md5(n) AS norm_md5, len(list_filter(string_split(n, ' '), lambda x: x <> '')) AS n_tokens FROM (SELECT doc_id, {_norm_diff('text')} AS n FROM documents)")
def norm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, N2."""
    own = table(spark, sf_dir, "documents").select("doc_id", T.normalize_for_diff(F.col("text")).alias("n"))
    return own.select("doc_id", F.md5("n").alias("norm_md5"), F.size(T.tokens(F.col("n"))).cast("long").alias("n_tokens"))


_MATCH_SQL = _squeeze(_sub("lower(html)", (r"<[^>]+>", ""), (r"&[a-z]+;", " "), (r"&#[0-9]+;", " "), (r"\[[0-9]+\]", ""), (r"\[footnote[^\]]*\]", ""), (r"\[(?:illustration|sidenote)[^\]]*\]", ""), (r"[^\p{L}\p{N}\s]", "")))


@query(
    "match_normalizers",
    f"""SELECT page_id, md5({_MATCH_SQL}) AS matching, md5({_sub(_squeeze("lower(html)"), (NW_SQL, ""))}) AS coarse,
        md5({_sub("trim(lower(html))", (NW_SQL, ""), (r"\s+", " "))}) AS gap, md5({_sub("html", ("<[^>]+>", ""))}) AS bare,
        len(regexp_extract_all(lower(html), '([a-z0-9]+(?:''[a-z]+)?)', 1)) AS n_gap_words, len(regexp_extract_all(html, '([a-zA-Z]+(?:[-''][a-zA-Z]+)*)', 1)) AS n_plain_words FROM pages""",
)
def match_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N7, N9, N11, N12, N16, N33."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.normalize_for_matching(h)).alias("matching"), F.md5(T.normalize_coarse(h)).alias("coarse"), F.md5(T.normalize_gap(h)).alias("gap"), F.md5(F.regexp_replace(h, "<[^>]+>", "")).alias("bare"), F.size(T.gap_words(h)).cast("long").alias("n_gap_words"), F.size(T.plain_words(h)).cast("long").alias("n_plain_words"))


_ALPHA_SQL = "length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"
_CAPS_SQL = "({x} = upper({x}) AND {x} <> lower({x}))"
_PARATEXT_SQL = (
    "x = '' OR NOT (regexp_matches(x, '^[0-9]+$') OR regexp_matches(x, '^Page\\s+[0-9]+$') OR (regexp_matches(x, '^[0-9]+\\s+[A-Z]') AND length(x) < 60)"
    f" OR ({_CAPS_SQL.format(x='x')} AND length(x) < 80 AND {_ALPHA_SQL.format(x='x')} > length(x) * 0.4 AND NOT regexp_matches(x, '[.\"!?]$'))"
    f" OR {_ALPHA_SQL.format(x='x')} < 5 OR regexp_matches(x, '^\\[.*[Ii]llustration'))"
)


@query("paratext_strip", f"SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: {_PARATEXT_SQL}), chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents)")
def paratext_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N6."""
    own = table(spark, sf_dir, "documents").select("doc_id", T.strip_paratext(F.col("text")).alias("t"))
    return own.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


_TRIM = "trim({c}, ' ' || chr(10) || chr(13) || chr(9))"
_REFUSAL_SQL = _quote("|".join(f"(?:{p})" for p in T.REFUSALS))
_LINE1 = "lower(trim(string_split(" + _TRIM.format(c="text") + ", chr(10))[1]))"


@query("page_quality_gate", f"SELECT conv_id, turn, CASE WHEN {_TRIM.format(c='coalesce(text, chr(32))')} = '' THEN 'empty' WHEN regexp_matches({_LINE1}, '{_REFUSAL_SQL}') THEN 'refusal' WHEN length(text) < {T.MIN_TRANSCRIPTION} THEN 'short' ELSE '' END AS fault FROM conversations")
def page_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27 over turns as pages."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.transcription_fault(F.col("text"), F.col("text")).alias("fault"))


_HEADER_SQL = "CASE WHEN length(trim(string_split({c}, chr(10))[1])) < 40 AND NOT regexp_matches(trim(string_split({c}, chr(10))[1]), '[.!?]$') THEN " + _TRIM.format(c="array_to_string(string_split({c}, chr(10))[2:], chr(10))") + " ELSE {c} END"


@query(
    "non_content",
    f"""SELECT doc_id, md5(t) AS body_md5, (len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) < 10 OR regexp_matches(t, '(?i)^\\s*contents\\s*[\\n\\r]') OR len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\\.\\s*){{4,}}'))) >= 2
        OR regexp_matches(t, '(\\.\\s*){{8,}}') OR contains(lower(t), 'color calibration') OR contains(lower(t), 'does not contain any text')) AS non_content
        FROM (SELECT doc_id, {_TRIM.format(c=_HEADER_SQL.format(c="text"))} AS t FROM documents)""",
)
def non_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19, F20."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.trim(T.strip_page_header(F.col("text")), F.lit(" \n\t\r")).alias("t"))
    return own.select("doc_id", F.md5("t").alias("body_md5"), T.is_non_content(F.col("t")).alias("non_content"))


@query(
    "language_heuristic",
    f"""SELECT doc_id, lang, CASE WHEN len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) > 50 THEN 'cjk' WHEN len(regexp_extract_all(text, '[\\x{{0400}}-\\x{{04ff}}]')) > 50 THEN 'cyrillic' WHEN len(regexp_extract_all(lower(text), '[äöüß]')) > 20 THEN 'german'
        WHEN len(list_filter(string_split_regex(lower(substring(text, 1, {T.LOOKED_AT})), '\\s+'), lambda x: regexp_replace(x, '[.,;:!?"'']+$', '') IN ({", ".join(f"'{w}'" for w in T.ENGLISH)}))) > 20 THEN 'english' ELSE 'unknown' END AS guess FROM documents""",
)
def language_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F60."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.language_guess(F.col("text")).alias("guess"))


# --- candidates and rules


def _lev(a: str, b: str) -> str:
    """DuckDB counts bytes: each letter outside ASCII becomes one byte first."""
    fold = "translate({}, 'éèêçöüäßñóíáúàâÉÈÊÇÖÜÄÑÓÍÁ“”’—†‡«', '0123456789@^{{}}|~`\\[]&_!#$%+=?/<>(')"
    return f"levenshtein({fold.format(a)}, {fold.format(b)})"


@query(
    "word_edit_categories",
    f"""WITH {_CAND_SQL} SELECT item_id, seq, CASE WHEN lower(pg_text) = lower(scan_text) THEN 'formatting_error'
        WHEN lower(regexp_replace(pg_text, '[^a-zA-Z]', '', 'g')) = lower(regexp_replace(scan_text, '[^a-zA-Z]', '', 'g')) AND regexp_replace(pg_text, '[^a-zA-Z]', '', 'g') <> '' THEN 'punctuation_diff'
        WHEN length(pg_text) > 2 AND length(scan_text) > 2 AND {_lev("lower(pg_text)", "lower(scan_text)")} = 1 THEN 'ocr_scanno' ELSE 'wrong_word' END AS category, {_lev("pg_text", "scan_text")} AS distance FROM cand""",
)
def word_edit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A65, N4."""
    a, b = F.col("pg_text"), F.col("scan_text")
    return candidates(spark, sf_dir).select("item_id", "seq", diff.category(a, b).alias("category"), F.levenshtein(a, b).cast("long").alias("distance"))


def _frag(c: str) -> str:
    return f"(trim({c}) = '' OR (NOT contains(trim({c}), ' ') AND length(trim({c})) < CASE WHEN right(trim({c}), 1) IN ('.', ',', ';', ':', '!', '?', ')', '\"', '''') THEN 4 ELSE 5 END))"


@query("fragment_filter", f"WITH {_CAND_SQL} SELECT item_id, seq, (NOT (length(pg_text) >= 10 AND length(scan_text) >= 10) AND ({_frag('pg_text')} OR {_frag('scan_text')})) AS is_fragment, (regexp_matches(pg_text, '\\{{[0-9]+[a-z]*\\}}') OR regexp_matches(scan_text, '\\{{[0-9]+[a-z]*\\}}')) AS has_page_reference FROM cand")
def fragment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F3."""
    a, b = F.col("pg_text"), F.col("scan_text")
    return candidates(spark, sf_dir).select("item_id", "seq", diff.is_fragment(a, b).alias("is_fragment"), diff.has_page_reference(a, b).alias("has_page_reference"))


def _american(c: str) -> str:
    c = f"lower(trim({c}))"
    for pattern, by in lexicon.BRITISH:
        c = f"regexp_replace({c}, '{pattern}', '{by}')"
    return c


def _usuk(a: str, b: str) -> str:
    x, y = f"lower(trim({a}))", f"lower(trim({b}))"
    keys = ", ".join(f"'{_quote(k)}'" for k in lexicon.us_uk_keys())
    return f"coalesce({x} <> {y} AND ({_american(a)} = {_american(b)} OR (least({x}, {y}) || '|' || greatest({x}, {y})) IN ({keys})), FALSE)"


def _m(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{_quote(p)}')"


def _pairs_sql(pairs: tuple[tuple[str, str], ...]) -> str:
    return " OR ".join(f"({_m('x', p)} AND {_m('y', q)}) OR ({_m('x', q)} AND {_m('y', p)})" for p, q in pairs)


_BARE = "regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
_RULES_SQL = f"""CASE WHEN contains(y, '(absent in pg)') OR contains(y, '(absent in scan)') THEN 'artifact'
        WHEN {_m("x", rules.TYPOGRAPHY_A)} OR {_m("y", rules.TYPOGRAPHY_B)} THEN 'typography' WHEN {_pairs_sql(rules.MODERNISED)} THEN 'modernization' WHEN {_pairs_sql(rules.EDITORIAL)} THEN 'edition'
        WHEN {_usuk(_BARE.format(c="x"), _BARE.format(c="y"))} THEN 'us_uk'
        WHEN {_BARE.format(c="x")} = {_BARE.format(c="y")} AND NOT regexp_matches(x || ' ' || y, '[a-z]\\.[a-z]') THEN 'punctuation'
        WHEN {_sub("x", (rf"({W_SQL})-\s*", r"\1"))} = {_sub("y", (rf"({W_SQL})-\s*", r"\1"))} THEN 'hyphenation' ELSE 'none' END"""


@query("rule_chain", f"WITH {_CAND_SQL}, low AS (SELECT item_id, seq, trim(lower(pg_text)) AS x, trim(lower(scan_text)) AS y FROM cand), said AS (SELECT item_id, seq, {_RULES_SQL} AS reason FROM low) SELECT item_id, seq, reason, reason IN ('typography', 'modernization', 'us_uk', 'punctuation', 'hyphenation') AS fp, CASE reason WHEN 'artifact' THEN 'alignment_artifact' WHEN 'edition' THEN 'edition_variant' END AS new_category FROM said")
def rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    v = rules.verdict(F.col("pg_text"), F.col("scan_text"), F.lit("wrong_word"))
    return candidates(spark, sf_dir).select("item_id", "seq", v.alias("v")).select("item_id", "seq", "v.reason", "v.fp", "v.new_category")


_ORDERED = "ordered AS (SELECT *, trim(pg_text) AS a, trim(scan_text) AS b, CASE WHEN length(trim(scan_text)) <= length(trim(pg_text)) THEN trim(scan_text) ELSE trim(pg_text) END AS s, CASE WHEN length(trim(scan_text)) <= length(trim(pg_text)) THEN trim(pg_text) ELSE trim(scan_text) END AS g FROM cand)"
_CORE = "trim(regexp_replace(regexp_replace(lower({c}), '\\s+([;:,.!?])', '\\1', 'g'), '[;:]', '', 'g'))"
_CUTOFF_SQL = "(NOT contains(pg_text, ' ') AND NOT contains(scan_text, ' ') AND length(g) - length(s) = 1 AND (starts_with(g, s) OR ends_with(g, s)) AND length(s) <= 3)"
_LONG_SQL = "(length(a) > 40 OR length(b) > 40)"
_HTML_SQL = "regexp_matches(scan_text || pg_text, '<div|<span|bbox=|!\\[\\]\\(|<img|</div')"
_CAPSH_SQL = f"({_CAPS_SQL.format(x='b')} AND length(b) > 5)"
_SUFFIX_SQL = "(NOT contains(s, ' ') AND length(g) - length(s) <= 3 AND ends_with(g, s) AND NOT (length(s) >= 4 AND (g = s || 's' OR g = s || 'es')) AND length(s) <= 8)"
_FILTERS_SQL = f"""CASE WHEN {_CUTOFF_SQL} THEN 'Cutoff artifacts' WHEN {_LONG_SQL} THEN 'Long mismatches' WHEN {_HTML_SQL} THEN 'HTML artifacts' WHEN {_CAPSH_SQL} THEN 'ALL CAPS headers' WHEN {_SUFFIX_SQL} THEN 'Suffix fragments'
        WHEN regexp_matches(s, '^[\"“”‘«]') AND length(g) - length(s) > 20 THEN 'Quoted fragments'
        WHEN (regexp_matches(pg_text, '\\([0-9]+\\)') AND regexp_matches(scan_text, '[*†‡]')) OR (regexp_matches(scan_text, '\\([0-9]+\\)') AND regexp_matches(pg_text, '[*†‡]')) THEN 'Footnote marker variants'
        WHEN length(a) <= 60 AND length(b) <= 60 AND {_CORE.format(c="a")} = {_CORE.format(c="b")} AND lower(a) <> lower(b) THEN 'Punctuation variants' END"""
_MARKED_SQL = f"WITH {_CAND_SQL}, {_ORDERED}, marked AS (SELECT item_id, seq, {_FILTERS_SQL} AS filter_name FROM ordered WHERE NOT (contains(pg_text, '(absent in PG)') OR contains(scan_text, '(absent in scan)')))"


@query("artifact_filters", f"{_MARKED_SQL} SELECT item_id, seq, filter_name, CASE WHEN filter_name IS NOT NULL THEN 'alignment_artifact' ELSE 'wrong_word' END AS category FROM marked")
def artifact_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F10, F18."""
    return rules.mark_artifacts(candidates(spark, sf_dir).withColumn("category", F.lit("wrong_word"))).select("item_id", "seq", "filter_name", "category")


@query("filter_counts", f"{_MARKED_SQL} SELECT filter_name, count(*) AS n FROM marked WHERE filter_name IS NOT NULL GROUP BY filter_name")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return artifact_filters(spark, sf_dir).filter("filter_name is not null").groupBy("filter_name").agg(F.count("*").alias("n"))


_TOK = "list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


@query(
    "report_filters",
    f"""WITH {_CAND_SQL}, {_ORDERED} SELECT item_id, seq, (pg_text = '' OR scan_text = '' OR {_BARE.format(c="pg_text")} = {_BARE.format(c="scan_text")}) AS punctuation_only,
        ({_HTML_SQL} OR regexp_matches(scan_text || pg_text, 'margin-|font-|style=|class=|text-align')) AS html,
        (length(s) > 0 AND length(s) <= 10 AND NOT contains(s, ' ') AND contains(lower(g), lower(s)) AND length(g) - length(s) >= 3) AS is_substring,
        (len(list_filter(list_intersect({_TOK.format(c="lower(pg_text)")}, {_TOK.format(c="lower(scan_text)")}), lambda x: length(x) > 3)) = 0 AND NOT (len({_TOK.format(c="pg_text")}) <= 2 AND len({_TOK.format(c="scan_text")}) <= 2)) AS unrelated,
        (b <> '' AND length(b) <= 40 AND ({_CAPS_SQL.format(x="b")} OR (len({_TOK.format(c="b")}) >= 2 AND len(list_filter({_TOK.format(c="b")}, lambda x: NOT regexp_matches(x, '^\\p{{Lu}}'))) = 0))) AS header,
        (len({_TOK.format(c="pg_text")}) > 1 AND array_to_string({_TOK.format(c="pg_text")}, '') = b) AS concatenated,
        (NOT (pg_text = '' OR scan_text = '' OR {_BARE.format(c="pg_text")} = {_BARE.format(c="scan_text")}) AND NOT (regexp_matches(s, '^["''“‘]') AND length(g) - length(s) > 10) AND NOT contains(lower(pg_text || scan_text), '(absent') AND NOT {_CUTOFF_SQL}
          AND NOT {_LONG_SQL} AND NOT ({_HTML_SQL} OR regexp_matches(scan_text || pg_text, 'margin-|font-|style=|class=|text-align')) AND NOT {_CAPSH_SQL} AND NOT {_SUFFIX_SQL} AND NOT contains(pg_text, 'FOOTNOTE') AND NOT contains(scan_text, 'FOOTNOTE')) AS submit FROM ordered""",
)
def report_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F30 to F43."""
    a, b = F.col("pg_text"), F.col("scan_text")
    return candidates(spark, sf_dir).select(
        "item_id", "seq", rules.report_punctuation_only(a, b).alias("punctuation_only"), rules.report_html(a, b).alias("html"), rules.report_substring(a, b).alias("is_substring"), rules.report_unrelated(a, b).alias("unrelated"),
        rules.looks_like_header(b).alias("header"), rules.is_concat_artifact(a, b).alias("concatenated"), rules.submit_ready(a, b, F.lit("wrong_word"), F.lit(0.5)).alias("submit"),
    )


@query("us_uk_variants", f"WITH {_CAND_SQL} SELECT item_id, seq, lower(pg_text) AS a, lower(scan_text) AS b FROM cand WHERE {_usuk('pg_text', 'scan_text')}")
def us_uk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the rules, and as a join with the pair table."""
    pairs = spark.createDataFrame([(k,) for k in lexicon.us_uk_keys()], "key string")
    own = candidates(spark, sf_dir).withColumn("key", lexicon.us_uk_key(F.col("pg_text"), F.col("scan_text")))
    listed = own.join(pairs, "key", "left_semi").select("item_id", "seq")
    ruled = own.filter(lexicon.is_us_uk(F.col("pg_text"), F.col("scan_text"), ())).select("item_id", "seq")
    found = listed.unionByName(ruled).distinct()
    return own.join(found, ["item_id", "seq"], "left_semi").select("item_id", "seq", F.lower("pg_text").alias("a"), F.lower("scan_text").alias("b"))


# --- variants

_PW = "regexp_extract_all({c}, '([a-zA-Z]+(?:[-''][a-zA-Z]+)*)', 1)"
_IN = ", ".join(f"'{w}'" for w in lexicon.FUNCTION_WORDS)
_NEG = ", ".join(f"'{_quote(w)}'" for w in lexicon.NEGATIONS)
_ABS = "(contains(pg_text, '(absent in') OR contains(scan_text, '(absent in'))"
_DEHYPH = "regexp_replace({c}, '([\\p{{L}}\\p{{N}}_])-\\s+', '\\1', 'g')"
_VARIANT_SQL = f"""WITH {_CAND_SQL}, parts AS (SELECT *, {_PW.format(c="pg_text")} AS x, {_PW.format(c="scan_text")} AS y FROM cand),
    zipped AS (SELECT *, list_filter(list_zip(x, y), lambda z: lower(z[1]) <> lower(z[2])) AS changed FROM parts),
    kinds AS (SELECT *, CASE WHEN contains(pg_text, '(absent in PG)') THEN 'added_content' WHEN {_ABS} THEN 'missing_content' WHEN {_squeeze("pg_text")} = {_squeeze("scan_text")} THEN 'normalization'
      WHEN {_sub("pg_text", (NW_SQL, ""))} = {_sub("scan_text", (NW_SQL, ""))} AND {_sub("pg_text", (NW_SQL, ""))} <> '' THEN 'punctuation_variant'
      WHEN len(x) = len(y) AND len(changed) > 0 AND len(list_filter(changed, lambda z: NOT ({_usuk("z[1]", "z[2]")}))) = 0 THEN 'spelling_change'
      WHEN {_squeeze(_DEHYPH.format(c="pg_text"))} = {_squeeze(_DEHYPH.format(c="scan_text"))} AND (regexp_matches(pg_text, '\\b\\w-\\s*\\n') OR regexp_matches(scan_text, '\\b\\w-\\s*\\n')) THEN 'linebreak_variant' ELSE 'textual_variant' END AS variant FROM zipped),
    sets AS (SELECT *, list_distinct({_PW.format(c="lower(pg_text)")}) AS lx, list_distinct({_PW.format(c="lower(scan_text)")}) AS ly, list_distinct(string_split(pg_text, '')) AS cx, list_distinct(string_split(scan_text, '')) AS cy,
      len(CASE WHEN contains(pg_text, '(absent in') THEN y ELSE x END) AS present FROM kinds),
    counted AS (SELECT *, len(list_filter(lx, lambda w: NOT list_contains(ly, w) AND w NOT IN ({_IN}))) + len(list_filter(ly, lambda w: NOT list_contains(lx, w) AND w NOT IN ({_IN}))) AS n,
      len(list_filter(cx, lambda c: NOT list_contains(cy, c) AND c IN ('.', '!', '?', ';', ':'))) + len(list_filter(cy, lambda c: NOT list_contains(cx, c) AND c IN ('.', '!', '?', ';', ':'))) AS marks,
      list_sort(list_filter(lx, lambda w: w IN ({_NEG}))) <> list_sort(list_filter(ly, lambda w: w IN ({_NEG}))) AS negated FROM sets),
    classified AS (SELECT item_id, seq, variant, CASE WHEN variant IN ('normalization', 'linebreak_variant') THEN 'trivial' WHEN variant = 'spelling_change' THEN 'minor' WHEN variant = 'punctuation_variant' THEN CASE WHEN marks > 0 THEN 'moderate' ELSE 'minor' END
      WHEN {_ABS} THEN CASE WHEN present = 0 THEN 'trivial' WHEN present <= 2 THEN 'minor' WHEN present <= 10 THEN 'moderate' ELSE 'major' END
      WHEN len(x) = 0 AND len(y) = 0 THEN 'trivial' WHEN negated THEN 'major' WHEN n = 0 THEN 'minor' WHEN n >= 3 THEN 'major' ELSE 'moderate' END AS significance FROM counted)"""


@query("variant_classification", f"{_VARIANT_SQL} SELECT * FROM classified")
def variant_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M28 to M34."""
    return variants.classify(candidates(spark, sf_dir)).select("item_id", "seq", "variant", "significance")


@query("variant_cube", f"{_VARIANT_SQL} SELECT coalesce(variant, '(all)') AS variant, coalesce(significance, '(all)') AS significance, count(*) AS n FROM classified GROUP BY CUBE (variant, significance)")
def variant_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G3, G4."""
    return variants.summary(variant_classification(spark, sf_dir))


@query("chapter_rollup", f"{_VARIANT_SQL} SELECT item_id % 10 AS chapter, min(seq) AS first_seq, min(item_id) AS first_page, max(item_id) AS last_page, count(*) AS n, {', '.join(f'count(*) FILTER (significance = {chr(39)}{s}{chr(39)}) AS {s}' for s in variants.ORDINAL)} FROM classified GROUP BY item_id % 10")
def chapter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14, items as pages, ten chapters."""
    return variants.chapter_rollup(variant_classification(spark, sf_dir).withColumn("chapter", F.col("item_id") % 10), page="item_id")


@query("significant_variants", f"{_VARIANT_SQL} SELECT * FROM classified WHERE significance IN ('major', 'moderate')")
def significant_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F45, applied (Q15)."""
    return variants.at_least(variant_classification(spark, sf_dir), "moderate")


@query("moderate_top50", f"{_VARIANT_SQL} SELECT item_id, seq, variant, significance, row_number() OVER (ORDER BY item_id, seq)::INT AS rank FROM classified WHERE significance = 'moderate' QUALIFY rank <= 50")
def moderate_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6."""
    return variants.top(variant_classification(spark, sf_dir), "moderate")


# --- edition pairs and their differences


@query(
    "near_copy_pairs",
    f"""WITH w AS (SELECT doc_id, {_WORDS_SQL.format(c="text")} AS w FROM documents), s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) >= 5),
    c AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS first FROM s), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM c WHERE doc_id = first),
    met AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT a_id, b_id, i / (na + nb - i) AS jaccard FROM met WHERE i / (na + nb - i) > 0.5 UNION ALL SELECT first, doc_id, 1.0 FROM c WHERE doc_id <> first""",
)
def near_copy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal texts, and their members."""
    return linked_classes(table(spark, sf_dir, "documents"))


def _diff(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = nearest_pairs(table(spark, sf_dir, "documents")).select("a_id", "b_id", "a_text", "b_text")
        return diff.candidates(diff.hunks(pairs, ["a_id", "b_id"], mode=mode))

    return run


for _mode in diff.MODES:
    QUERIES[f"diff_{_mode}"] = _diff(_mode)


@query("diff_category_summary")
def diff_category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: near copies, their word differences, and how many of each category."""
    found = _diff("recursive")(spark, sf_dir)
    return found.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("a_id", "b_id").alias("pairs"))


@query(
    "unique_word_anchors",
    r"""WITH p AS (SELECT conv_id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, turn FROM conversations), t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS a, regexp_extract_all(lower(nxt), '([a-z0-9]+)', 1) AS b FROM p WHERE nxt IS NOT NULL),
    ax AS (SELECT conv_id, turn, w, min(i) AS a_pos FROM (SELECT conv_id, turn, unnest(a) AS w, unnest(range(len(a))) AS i FROM t) WHERE length(w) >= 4 GROUP BY ALL HAVING count(*) = 1), bx AS (SELECT conv_id, turn, w, min(i) AS b_pos FROM (SELECT conv_id, turn, unnest(b) AS w, unnest(range(len(b))) AS i FROM t) WHERE length(w) >= 4 GROUP BY ALL HAVING count(*) = 1)
    SELECT conv_id, turn, w AS word, a_pos, b_pos FROM ax JOIN bx USING (conv_id, turn, w)""",
)
def unique_word_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four letters or more that two following pages both have once."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(after).alias("next")).filter("next is not null")

    def once(c: str, name: str) -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.col(c)), F.lit("([a-z0-9]+)"), F.lit(1))
        return own.select("conv_id", "turn", F.posexplode(words).alias("i", "word")).filter("length(word) >= 4").groupBy("conv_id", "turn", "word").agg(F.min("i").cast("long").alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")

    return once("text", "a_pos").join(once("next", "b_pos"), ["conv_id", "turn", "word"])


from variorum import queries_pages  # noqa: E402  registers its queries

queries_pages.register_scores()

"""Rows as JSON of fixed shapes, and the tables around a batch of books: editions, queues, comparisons, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.operators import dictionary, markdown

# fixed values: patterns of an edition's year and publisher, in this order, and where they are looked for
YEARS = (r"Edition[^.]*?(\d{4})", r"published[^.]*?(\d{4})", r"Copyright,?\s*(\d{4})", r"(\d{4})\s*by\s+", r"First (?:edition|published)[^.]*?(\d{4})")
PUBLISHERS = (r"(?:Published by|Printed by|published for)\s+([^.,\n]+)", r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+(?:&|and)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)*)")
START, END = "*** START OF THIS PROJECT GUTENBERG", "*** END OF THIS PROJECT GUTENBERG"
HEAD, BODY, FRONT, FOOT = 3000, 10000, 3000, 2000
# fixed values: words with an abbreviation's spaces, the budget in tokens, and characters a token
LATIN, BUDGET, TOKEN = r"(?i)\b([ievqsf])\.\s+([a-z])\.", 80_000, 4
# fixed values: columns of an error's JSON, and of a gap's with those of holes alone
ERROR = ("pg_text", "scan_text", "pg_offset", "scan_page", "diff_description", "verdict", "confidence", "reasoning", "suggested_fix", "image_evidence", "scan_image_path", "location_description", "category", "severity", "pg_file_line", "chapter_title")
GAP, HOLE = ("page", "strategy", "word_count", "scan_text_preview", "coverage_ratio", "pg_verified", "pg_match_ratio", "non_content", "confidence"), ("missing_words", "pg_context_before", "pg_context_after")


def _fields(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit("")).alias(c) for c in names]


def error_rows(errors: DataFrame, file_line: str | None = None) -> DataFrame:
    """(book_id, seq, error) with an error's fields as one struct; a line of 0 is the candidate's, file_line."""
    own = errors if "severity" in errors.columns else markdown.prepared(errors)
    if file_line:
        own = own.withColumn("pg_file_line", F.coalesce(F.nullif("pg_file_line", F.lit(0)), F.col(file_line)))
    return own.select("book_id", "seq", F.struct(*_fields(own, ERROR)).alias("error"))


def report_json(errors: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, json) of each book: its own columns as metadata, counts, and its errors but for artefacts.

    A book's errors are one array, so one row of the result.
    """
    kept = markdown.prepared(errors).filter("category <> 'alignment_artifact'")
    c = F.col("confidence")
    counts = kept.groupBy("book_id").agg(
        F.struct(
            F.count("*").alias("total_candidates"), F.count_if(c >= markdown.HIGH).alias("high_confidence_errors"), F.count_if((c >= markdown.MEDIUM) & (c < markdown.HIGH)).alias("medium_confidence_errors"), F.count_if(c < markdown.MEDIUM).alias("low_confidence_errors"),
            F.count_if(F.col("category") == "edition_variant").alias("edition_variants"), F.count_if(F.col("category").isin("modernization", "intentional_change")).alias("intentional_changes"),
        ).alias("summary")
    )
    rows = error_rows(kept).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda x: x["error"]).alias("errors"))
    own = books.select("book_id", F.struct(*books.columns).alias("metadata"))
    met = own.join(counts, "book_id", "left").join(rows, "book_id", "left")
    return met.select("book_id", F.to_json(F.struct("metadata", "summary", "errors")).alias("json"))


def alignment_json(alignments: DataFrame) -> DataFrame:
    """Alignments with `json`, by book and start."""
    names = ("pg_start", "pg_end", "scan_page", "scan_image_path", "confidence", "method")
    return alignments.withColumn("json", F.to_json(F.struct(*_fields(alignments, names)))).orderBy("book_id", "pg_start", "scan_page")


def edition_alignment_json(alignments: DataFrame) -> DataFrame:
    """Alignments of two editions (a_start, a_end, a_pages, b_start, b_end, b_pages, confidence) with `json`, by A's start."""
    sides = [F.struct(F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"), F.col(f"{s}_pages").alias("pages")).alias(f"edition_{s}") for s in "ab"]
    return alignments.withColumn("json", F.to_json(F.struct(*sides, "confidence"))).orderBy("book_id", "a_start", "b_start")


def variant_json(variants: DataFrame) -> DataFrame:
    """Variants with `json`; sides are (pg_text, a_page, pg_offset) and (scan_text, b_page, b_offset), what is missing is empty."""
    side = [F.struct(*(x.alias(n) for x, n in zip(_fields(variants, names), ("text", "page", "offset"), strict=True))) for names in (("pg_text", "a_page", "pg_offset"), ("scan_text", "b_page", "b_offset"))]
    more = _fields(variants, ("context", "chapter_title"))
    return variants.withColumn("json", F.to_json(F.struct(F.col("variant").alias("category"), "significance", "confidence", side[0].alias("edition_a"), side[1].alias("edition_b"), *more)))


def comparison_json(variants: DataFrame, editions: DataFrame) -> DataFrame:
    """(book_id, json) of a comparison: both editions' columns a_... and b_..., counts, and the variants."""
    told = variant_json(variants)
    rows = told.groupBy("book_id").agg(F.count("*").alias("total_variants"), F.transform(F.array_sort(F.collect_list(F.struct("b_page", "seq", "json"))), lambda x: x["json"]).alias("variants"))
    for name, column in (("by_category", "variant"), ("by_significance", "significance")):
        counts = variants.groupBy("book_id", column).agg(F.count("*").alias("n")).groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))
        rows = rows.join(counts, "book_id")
    sides = [F.struct(*(F.col(c).alias(c[2:]) for c in editions.columns if c.startswith(f"{s}_"))).alias(f"edition_{s}") for s in "ab"]
    met = editions.select("book_id", *sides).join(rows, "book_id", "left")
    return met.select("book_id", F.to_json(F.struct("edition_a", "edition_b", F.struct(F.coalesce("total_variants", F.lit(0)).alias("total_variants"), "by_category", "by_significance").alias("summary"), "variants")).alias("json"))


def gap_json(gaps: DataFrame) -> DataFrame:
    """Gaps with `json`: the ratio to three places, what surrounds it for holes alone."""
    own = gaps.withColumn("scan_text_preview", F.col("preview")) if "scan_text_preview" not in gaps.columns else gaps
    own = own.withColumn("pg_match_ratio", F.round("pg_match_ratio", 3)).withColumn("non_content", F.col("non_content") if "non_content" in own.columns else F.lit(False))
    return own.withColumn("json", F.when(F.col("strategy") == "content_hole", F.to_json(F.struct(*_fields(own, (*GAP, *HOLE))))).otherwise(F.to_json(F.struct(*_fields(own, GAP)))))


def edition_info(text: Column) -> Column:
    """struct(year, publisher, copyright_year, transcriber_notes) of a book's text; null for what isn't there."""
    produced = F.substring(F.trim(F.regexp_extract(F.substring(text, 1, HEAD), r"Produced by\s+(.+?)(?:\n|$)", 1)), 1, 200)
    start, end = F.greatest(F.instr(text, F.lit(START)), F.lit(1)), F.instr(text, F.lit(END))
    body = F.substring(text, start, F.lit(BODY))
    foot = F.when(end > 0, F.substring(text, F.greatest(F.lit(1), end - FOOT), F.least(F.lit(FOOT), end - 1)))

    def first(c: Column, patterns: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in patterns))

    return F.struct(
        first(body, tuple(f"(?i){p}" for p in YEARS)).alias("year"),
        first(F.substring(body, 1, FRONT), PUBLISHERS).alias("publisher"),
        first(foot, (r"(?i)Copyright,?\s*(\d{4})",)).alias("copyright_year"),
        F.nullif(produced, F.lit("")).alias("transcriber_notes"),
    )


def book_number(name: Column) -> Column:
    """The book's number in a report's file name; null without one."""
    return F.nullif(F.regexp_extract(name, r"gutenberg(\d+)", 1), F.lit("")).cast("long")


def page_range(said: str | None) -> tuple[int, int] | None:
    """`48-100` as two numbers; None for nothing."""
    if not said:
        return None
    low, dash, high = said.partition("-")
    if not dash or "-" in high:
        raise ValueError(f"a page range is START-END, not {said!r}")
    return int(low), int(high)


def work_queue(books: DataFrame, done: DataFrame, skip: DataFrame, offset: int = 0, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue, skipped) of books (book_id, rank, language, scan_id).

    done is (book_id), skip (book_id, reason). A book is left out for the first of:
    it is done, it is in skip, its language isn't English, it has no scan. The queue
    is in the order of rank, from `offset`, `most` books at most.
    """
    known = books.join(done.select("book_id").distinct().withColumn("__done", F.lit(True)), "book_id", "left").join(skip.groupBy("book_id").agg(F.min("reason").alias("__skip")), "book_id", "left")
    why = (
        F.when(F.col("__done"), "already processed").when(F.col("__skip").isNotNull(), F.col("__skip"))
        .when(F.coalesce("language", F.lit("")) != "english", F.concat(F.lit("language="), F.coalesce("language", F.lit("unknown"))))
        .when(F.coalesce("scan_id", F.lit("")) == "", "no scan found")
    )
    told = known.withColumn("reason", why).drop("__done", "__skip")
    queue = told.filter("reason is null").drop("reason").orderBy("rank", "book_id").offset(offset)
    return (queue if most is None else queue.limit(most)), told.filter("reason is not null").select("book_id", "reason")


def compare_counts(before: DataFrame, after: DataFrame, key: str = "category") -> DataFrame:
    """(key, before, after, delta) of counts (key, n) on either side."""
    met = before.select(key, F.col("n").alias("before")).join(after.select(key, F.col("n").alias("after")), key, "full")
    b, a = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return met.select(key, b.alias("before"), a.alias("after"), (a - b).alias("delta"))


def tokens_of(text: Column) -> Column:
    """About how many tokens a text has."""
    return F.floor(F.length(text) / TOKEN).cast("long")


def within_budget(errors: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(book_id, json, full, compact): surer errors in full, others by four fields, or not at all beyond the budget."""
    own = markdown.prepared(errors)
    page = F.coalesce(F.col("leaf"), F.col("scan_page").cast("long")).alias("page")
    sure = F.col("confidence") >= markdown.MEDIUM
    whole = own.filter(sure).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(*_fields(own, ERROR))).alias("j")))), lambda x: x["j"]).alias("full"))
    rest = own.filter(~sure).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct("pg_text", "scan_text", page, "confidence")).alias("j")))), lambda x: x["j"]).alias("compact"))
    met = whole.join(rest, "book_id", "full").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("full", "compact")})
    everything = F.concat(F.lit('{"errors":['), F.array_join(F.concat("full", "compact"), ","), F.lit("]}"))
    fits = tokens_of(everything) <= budget
    alone = F.concat(F.lit('{"errors":['), F.array_join("full", ","), F.lit("]}"))
    return met.select("book_id", F.when(fits, everything).otherwise(alone).alias("json"), F.size("full").cast("long").alias("full"), F.when(fits, F.size("compact")).otherwise(0).cast("long").alias("compact"))


def entry(a: Column, b: Column) -> Column:
    """struct(find, replace) without tags; null where one is empty or both are the same."""
    x, y = (F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"^\s+|\s+$", "") for c in (a, b))
    return F.when((x != "") & (y != "") & (x != y), F.struct(x.alias("find"), y.alias("replace")))


def folded(word: Column) -> Column:
    """A word in lower case without accents."""
    return F.lower(dictionary.fold(word, "NFKD"))


def recurring(errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest) of errors: one-word pairs whose word is found wrong twice or more, and the errors that aren't among them.

    pairs is (book_id, pg_text, scan_text, occurrences, caught); occurrences counts
    the errors of all pairs of the word.
    """
    own = errors.withColumn("__e", entry(F.col("pg_text"), F.col("scan_text")))
    x, y = F.col("__e.find"), F.col("__e.replace")
    letters = [F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "") for c in (x, y)]
    fits = F.col("__e").isNotNull() & ~x.contains(" ") & ~y.contains(" ") & (F.abs(F.length(x) - F.length(y)) <= 5) & (letters[0] != letters[1])
    named = own.withColumn("__find", F.when(fits, x)).withColumn("__replace", F.when(fits, y))
    pairs = named.filter("__find is not null").groupBy("book_id", "__find", "__replace").agg(F.count("*").alias("caught"))
    pairs = pairs.withColumn("occurrences", F.sum("caught").over(Window.partitionBy("book_id", "__find"))).filter("occurrences >= 2")
    rest = named.join(pairs.select("book_id", "__find", "__replace"), ["book_id", "__find", "__replace"], "left_anti").select(errors.columns)
    return pairs.select("book_id", F.col("__find").alias("pg_text"), F.col("__replace").alias("scan_text"), "occurrences", "caught"), rest


def is_latin_spacing(a: Column, b: Column) -> Column:
    """the witness has spaces in an abbreviation that the base text writes without."""
    return b.rlike(LATIN) & ~a.rlike(LATIN)


def text_chunks(text: Column, least: int = 40, most: int = 300) -> Column:
    """A text's sentences in chunks of about `most` characters; a chunk begins with the last one's last sentence, if that had several.

    Chunks of under `least` characters are left out.
    """
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("now"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] + F.length(x) > most) & (F.size(s["now"]) > 0)
        kept = F.when(~full, s["now"]).when(F.size(s["now"]) > 1, F.slice(s["now"], -1, 1)).otherwise(empty)
        size = F.when(~full, s["n"]).when(F.size(s["now"]) > 1, F.length(F.element_at(s["now"], -1))).otherwise(0)
        return F.struct(F.when(full, F.concat(s["out"], F.array(F.array_join(s["now"], " ")))).otherwise(s["out"]).alias("out"), F.concat(kept, F.array(x)).alias("now"), (size + F.length(x)).alias("n"))

    done = F.aggregate(sentences, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["out"], F.array(F.array_join(s["now"], " ")))).otherwise(s["out"]))
    return F.filter(done, lambda c: F.length(c) >= least)


def distinctive_probe(text: Column, skip: int = 30) -> Column:
    """30 to 80 characters from behind the first sentence's end, to be looked for in a book; null for a short page."""
    body = F.substring(text, skip + 1, 1 << 30)

    def after(c: Column, low: int, high: int, keep: Column, otherwise: Column) -> Column:
        out = None
        for mark in (". ", "! ", "? "):
            at = F.instr(c, F.lit(mark)) - 1
            found = (at >= low) & (at <= high)
            out = F.when(found, keep(at)) if out is None else out.when(found, keep(at))
        return out.otherwise(otherwise)

    rest = after(body, 1, 59, lambda at: F.substring(body, at + 3, F.length(body)), body)
    head = F.transform(F.array(rest), lambda r: F.struct(r.alias("r"), F.substring(r, 1, 80).alias("h")))[0]
    phrase = F.transform(F.array(head), lambda x: after(x["h"], 30, 80, lambda at: F.substring(x["h"], F.lit(1), at + 1), x["h"]))[0]
    trimmed = F.regexp_replace(phrase, r"^\s+|\s+$", "")
    return F.when((F.length(body) >= 20) & (F.length(head["r"]) >= 20) & (F.length(trimmed) >= 20), trimmed)


def nearer_occurrence(text: Column, phrase: Column, offset: Column) -> Column:
    """Of a phrase's first two places the nearer to offset, the first of equals; null for none."""
    first = F.instr(text, phrase)
    second = F.when(first > 0, F.instr(F.substring(text, first + 1, F.length(text)), phrase))
    next_at = F.when(second > 0, first + second)
    return F.when(first == 0, None).when(next_at.isNotNull() & (F.abs(first - 1 - offset) > F.abs(next_at - 1 - offset)), next_at - 1).otherwise(first - 1).cast("long")


def union_of_candidates(*parts: DataFrame) -> DataFrame:
    """Rows of differences, gaps and holes as one table; columns that a part lacks are null there."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


# fixed values: what a report's errors have where they say nothing
DEFAULTS = {"category": "ocr_scanno", "severity": "high", "verdict": "unable_to_verify", "confidence": 0.0, "pg_file_line": 0, "scan_page": 0, "pg_offset": 0}
NUMBERS = {"confidence": "double", "pg_file_line": "long", "scan_page": "long", "pg_offset": "long"}


def errors_of(reports: DataFrame) -> DataFrame:
    """(book_id, seq, an error's columns) of reports (book_id, json), as report_json writes them, in their order.

    Reports that aren't JSON, or have no errors, give no row; missing fields have
    their defaults, texts the empty one.
    """
    schema = "struct<errors:array<struct<" + ",".join(f"{c}:{NUMBERS.get(c, 'string')}" for c in ERROR) + ">>>"
    own = reports.select("book_id", F.posexplode(F.from_json("json", schema)["errors"]).alias("seq", "e"))
    return own.select("book_id", F.col("seq").cast("long").alias("seq"), *(F.coalesce(F.col(f"e.{c}"), F.lit(DEFAULTS.get(c, "")).cast(NUMBERS.get(c, "string"))).alias(c) for c in ERROR))


def scan_of(source: Column) -> Column:
    """The scan's name in its address; null without one."""
    return F.nullif(F.regexp_extract(source, r"archive\.org/details/([a-zA-Z0-9_-]+)", 1), F.lit(""))


def page_at(offset: Column, size: Column, pages: Column) -> Column:
    """About which page a place in the stitched text is on, by its share of the text; 0 for no text or pages."""
    place = F.floor(offset / size * pages)
    return F.when((size == 0) | (pages == 0), 0).otherwise(F.greatest(F.lit(0), F.least(place, pages - 1))).cast("long")

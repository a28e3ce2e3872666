"""Reports as ordered lines: (book_id, section, n, text), a row a line or a block, which `document` joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators import pages, report, rules

# fixed values: what is set before an error that needs a decision, and what is to be done, by its verdict
REVIEW = {
    "unable_to_verify": ("[?]", "Check scan and decide if PG punctuation is wrong"),
    "ambiguous": ("[?]", "Check scan and decide if PG punctuation is wrong"),
    "edition_variant": ("[E]", "Classified as edition variant - likely NOT an error"),
    "intentional_modernization": ("[M]", "Classified as intentional modernization - likely NOT an error"),
    "pg_correct": ("[M]", "Classified as intentional change - likely NOT an error"),
    "scan_correct": ("[~]", "Low confidence - verify before submitting"),
}
# fixed values: categories that are no errors to send, confidence limits, words of context, words of a long gap
QUIET, HIGH, MEDIUM, AROUND, LONG_GAP = ("edition_variant", "modernization", "intentional_change", "alignment_artifact"), 0.8, 0.5, 30, 100
LINE = ["book_id", "section", "n", "text"]


def percent(c: Column) -> Column:
    """A share in whole per cent, halves to even."""
    return F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))


def bare(c: Column) -> Column:
    """A text without tags."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")


def thousands(c: Column) -> Column:
    """A number with commas."""
    return F.format_number(c.cast("long"), 0)


def _has(df: DataFrame, name: str, default: object, kind: str) -> Column:
    return F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in df.columns else F.lit(default).cast(kind)


def prepared(errors: DataFrame) -> DataFrame:
    """errors with all columns that the reports name: missing ones and nulls are empty; leaf is the scan viewer's page."""
    kinds = {"reasoning": ("", "string"), "suggested_fix": ("", "string"), "image_evidence": ("", "string"), "chapter_title": ("", "string"), "scan_id": ("", "string"), "pg_file_line": (0, "long"), "confidence": (0.0, "double"), "verdict": ("unable_to_verify", "string"), "category": ("", "string")}
    out = errors.withColumns({c: _has(errors, c, *k) for c, k in kinds.items()})
    out = out.withColumn("leaf", _has(errors, "leaf", None, "long") if "leaf" in errors.columns else F.col("scan_page").cast("long"))
    return out.withColumn("severity", report.severity(F.col("category"))) if "severity" not in errors.columns else out


def _joined(*parts: Column, by: str = "; ") -> Column:
    return F.concat_ws(by, *parts)


def _link() -> Column:
    return F.when((F.col("scan_id") != "") & F.col("leaf").isNotNull(), report.page_url(F.col("scan_id"), F.col("leaf")))


def needs_review(e: DataFrame, with_line: bool) -> DataFrame:
    """M61's choice: all but artefacts and sure corrections, which with_line must also have their line."""
    sure = (F.col("verdict") == "scan_correct") & (F.col("confidence") >= HIGH)
    sure = sure & (F.col("pg_file_line") > 0) if with_line else sure
    return e.filter((F.col("category") != "alignment_artifact") & ~sure)


def _numbered(e: DataFrame, order: str = "seq") -> DataFrame:
    return e.withColumn("n", F.row_number().over(Window.partitionBy("book_id").orderBy(order)).cast("long"))


def review_lines(errors: DataFrame, books: DataFrame) -> DataFrame:
    """The items that need a decision, in order of seq; books has (book_id, title).

    A correction below the limit that is sure enough otherwise has no rule and no entry.
    """
    own = needs_review(prepared(errors), True)
    counts = books.join(own.groupBy("book_id").agg(F.count("*").alias("items")), "book_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    head = counts.select("book_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("n"), F.concat(
        F.lit("Quality Audit Review Items: "), F.coalesce("title", F.lit("")), F.lit(" (PG #"), F.col("book_id").cast("string"), F.lit(")\n\n"),
        F.when(F.col("items") == 0, "0 items need review - errata_email.txt is ready to submit.").otherwise(F.concat(F.col("items").cast("string"), F.lit(" items need your decision before submission\n---\n"))),
    ).alias("text"))
    mark, action = (F.element_at(F.create_map(*(F.lit(x) for k, v in REVIEW.items() for x in (k, v[i]))), F.col("verdict")) for i in (0, 1))
    told = _numbered(own.filter(F.col("verdict").isin(*REVIEW) & ((F.col("verdict") != "scan_correct") | (F.col("confidence") < HIGH))))
    where = _joined(F.when(F.col("pg_file_line") > 0, F.concat(F.lit("Line "), F.col("pg_file_line").cast("string"))), F.concat(F.lit("Page "), F.col("leaf").cast("string")), F.when(F.col("chapter_title") != "", F.concat(F.lit("("), F.col("chapter_title"), F.lit(")"))), by=", ")
    body = _joined(
        F.concat(mark, F.lit(" "), F.when(where == "", "Unknown location").otherwise(where)),
        F.concat(F.lit("    PG text: "), bare(F.col("pg_text"))),
        F.concat(F.lit("    Scan text: "), bare(F.col("scan_text"))),
        F.concat(F.lit("    Verdict: "), F.col("verdict"), F.lit(" ("), percent(F.col("confidence")), F.lit(")")),
        F.when(F.col("reasoning") != "", F.concat(F.lit("    Reasoning: "), F.col("reasoning"))),
        F.concat(F.lit("    Action needed: "), action),
        F.when(_link().isNotNull(), F.concat(F.lit("    Scan page: "), _link())),
        by="\n",
    )
    return head.unionByName(told.select("book_id", F.lit(1).alias("section"), "n", F.concat(body, F.lit("\n")).alias("text")))


def audit_lines(errors: DataFrame, books: DataFrame) -> DataFrame:
    """The audit report. books has (book_id, title, author, scan_source, pages_checked, total_pages, coverage)."""
    e = prepared(errors)
    c, kept = F.col("confidence"), F.col("category") != "alignment_artifact"
    counts = e.groupBy("book_id").agg(
        F.count_if(kept & (c >= HIGH)).alias("high"), F.count_if(kept & (c >= MEDIUM) & (c < HIGH)).alias("medium"), F.count_if(kept & (c < MEDIUM)).alias("low"),
        F.count_if(F.col("category") == "edition_variant").alias("variants"), F.count_if(F.col("category") == "intentional_change").alias("changes"), F.count_if(kept).alias("total"),
    )
    b = books.join(counts, "book_id", "left").fillna(0, ["high", "medium", "low", "variants", "changes", "total"])

    def row(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"| {label} | "), value.cast("string"), F.lit(" |"))

    head = _joined(
        F.concat(F.lit("# Quality Audit Report: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("**PG #"), F.col("book_id").cast("string"), F.lit("** by "), F.coalesce("author", F.lit("")), F.lit("\n")),
        F.concat(F.lit("**Scan source:** "), F.coalesce("scan_source", F.lit("")), F.lit("\n")), F.lit("## Summary\n\n| Metric | Value |\n|--------|-------|"),
        row("Pages checked", F.concat(F.col("pages_checked").cast("string"), F.lit(" / "), F.col("total_pages").cast("string"))), row("Text coverage", percent(F.col("coverage"))),
        F.lit("\n## Error Summary\n\n| Category | Count |\n|----------|-------|"),
        row("High confidence errors", F.col("high")), row("Medium confidence errors", F.col("medium")), row("Low confidence errors", F.col("low")), row("Edition variants", F.col("variants")), row("Intentional changes", F.col("changes")), row("**Total candidates**", F.col("total")),
        F.when(F.col("total") == 0, "\n## Errors\n\nNo discrepancies found. The PG text matches the scan well."), by="\n",
    )
    place = _joined(F.when(F.col("pg_file_line") > 0, F.concat(F.lit("line "), F.col("pg_file_line").cast("string"))), F.when(F.col("chapter_title") != "", F.concat(F.lit("chapter: "), F.col("chapter_title"))), by=", ")
    says = F.concat(F.lit('PG has "'), bare(F.col("pg_text")), F.lit('" vs scan "'), bare(F.col("scan_text")), F.lit('"'))
    page = F.concat(F.lit("**Page "), F.col("leaf").cast("string"))
    short = F.concat(F.col("n").cast("string"), F.lit(". "), page, F.when(place == "", "").otherwise(F.concat(F.lit(" ("), place, F.lit(")"))), F.lit(":** "), says, F.lit(" (confidence: "), percent(c), F.lit(")"))
    variant = F.concat(F.lit("- "), page, F.lit(":** "), says, F.when(F.col("reasoning") != "", F.concat(F.lit("\n  - "), F.col("reasoning"))).otherwise(""))
    full_place = _joined(F.when(F.col("pg_file_line") > 0, F.concat(F.lit("**File line:** "), F.col("pg_file_line").cast("string"))), F.when(F.col("chapter_title") != "", F.concat(F.lit("**Chapter:** "), F.col("chapter_title"))), F.concat(F.lit("**Scan page:** "), F.col("leaf").cast("string")))
    block = _joined(
        F.concat(F.lit("### Error "), F.col("n").cast("string"), F.lit(" - "), F.col("category"), F.lit(" (confidence: "), percent(c), F.lit(")\n")),
        F.concat(F.lit("- "), full_place), F.concat(F.lit('- **PG text:** "'), bare(F.col("pg_text")), F.lit('"')), F.concat(F.lit('- **Scan text:** "'), bare(F.col("scan_text")), F.lit('"')),
        F.concat(F.lit("- **Type:** `"), F.col("category"), F.lit("`")), F.concat(F.lit("- **Severity:** "), F.col("severity")),
        F.when(F.col("reasoning") != "", F.concat(F.lit("- **Reasoning:** "), F.col("reasoning"))), F.when(F.col("suggested_fix") != "", F.concat(F.lit("- **Suggested fix:** `"), F.trim("pg_text"), F.lit(" ==> "), F.col("suggested_fix"), F.lit("`"))),
        F.when(_link().isNotNull(), F.concat(F.lit("- **Scan page:** "), _link())), by="\n",
    )
    sections = (
        (2, "## Edition Variants", F.col("category") == "edition_variant", variant),
        (3, "## High Confidence Errors", (F.col("verdict") == "scan_correct") & (c >= HIGH) & ~F.col("category").isin(*QUIET), F.concat(block, F.lit("\n"))),
        (4, "## Medium Confidence Errors", kept & (c >= MEDIUM) & (c < HIGH), short),
        (5, "## Low Confidence Errors", kept & (c < MEDIUM), short),
    )
    out = [b.select("book_id", F.lit(1).alias("section"), F.lit(0).cast("long").alias("n"), F.concat(head, F.lit("\n")).alias("text"))]
    for number, title, test, text in sections:
        own = _numbered(e.filter(test)).select("book_id", F.lit(number).alias("section"), "n", text.alias("text"))
        out += [own, own.select("book_id", "section", F.lit(0).cast("long").alias("n"), F.lit(f"{title}\n").alias("text")).distinct()]
    return reduce(DataFrame.unionByName, out)


def clean_transcription(text: Column, headers: Column) -> Column:
    """A page's lines without page numbers and running headers, with its empty lines; headers is an array."""

    def noise(x: Column) -> Column:
        after, before = F.regexp_extract(x, r"^\d{1,4}\s+(.+)$", 1), F.regexp_extract(x, r"^(.+?)\s+\d{1,4}$", 1)
        parts = [(p != "") & (F.array_contains(headers, p) | rules.looks_like_header(p)) for p in (after, before)]
        return x.rlike(r"^\d{1,4}$") | F.array_contains(headers, x) | parts[0] | parts[1]

    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x == "") | ~noise(x))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def around(text: Column, end: Column, start: Column) -> Column:
    """The line with the words of the base text before and after a gap; '' without either."""
    head = F.regexp_replace(F.substring(text, F.lit(1), end.cast("int")), r"\S*$", "")
    tail = F.regexp_replace(F.substring(text, (start + 1).cast("int"), F.length(text)), r"^\S*", "")
    last = lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - (AROUND - 1)), F.lit(AROUND))
    before = F.coalesce(F.replace(F.array_join(last(T.tokens(head)), " "), F.lit("_"), F.lit("")), F.lit(""))
    after = F.coalesce(F.replace(F.array_join(F.slice(T.tokens(tail), 1, AROUND), " "), F.lit("_"), F.lit("")), F.lit(""))
    return F.when((before == "") & (after == ""), "").otherwise(F.concat(F.lit("PG context: "), F.when(before == "", "").otherwise(F.concat(F.lit("..."), before, F.lit(" "))), F.lit("[gap]"), F.when(after == "", "").otherwise(F.concat(F.lit(" "), after, F.lit("...")))))


def gap_lines(gaps: DataFrame, own: DataFrame, alignments: DataFrame, books: DataFrame, book: str = "book_id", page: str = "page_num") -> DataFrame:
    """Gaps as lines: content holes by themselves, other gaps by runs of pages with their cleaned text.

    gaps is what gaps.all_gaps gives, own (book, page, text), alignments (book,
    scan_page, pg_start, pg_end), books (book, body_text).
    """
    first_header = pages.running_headers(own, book, page, "text").groupBy(book).agg(F.collect_set("line").alias("headers"))
    g = gaps.join(first_header, book, "left").withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))
    label = F.concat(F.lit(" ["), F.upper("confidence"), F.lit("]:"))
    hole = g.filter("strategy = 'content_hole'")
    said = clean_transcription(F.col("missing_words"), F.col("headers"))
    text = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" - "), F.col("word_count").cast("string"), F.lit(" words"), label, F.lit('\nMissing: "'), F.when(said == "", F.col("missing_words")).otherwise(said), F.lit('"\n'))
    holes = hole.select(F.col(book).alias("book_id"), F.lit(1).alias("section"), F.col("page").cast("long").alias("n"), text.alias("text"))
    rest = g.filter("strategy <> 'content_hole'").join(own.select(F.col(book), F.col(page).alias("page"), F.col("text").alias("whole")), [book, "page"], "left")
    raw = F.when(F.coalesce("whole", F.lit("")) == "", F.col("preview")).otherwise(F.col("whole"))
    runs = pages.islands(rest.withColumn("clean", clean_transcription(raw, F.col("headers"))).groupBy(book, "page").agg(F.min_by(F.struct("clean", "confidence", "preview", "word_count"), "strategy").alias("x")).select(book, "page", "x.*"), book, "page")
    listed = F.array_sort(F.collect_list(F.struct("page", "clean", "confidence", "preview", "word_count")))
    group = runs.groupBy(book, "run_start").agg(listed.alias("x")).withColumns({"first": F.col("x")[0]["page"], "last": F.element_at("x", -1)["page"], "level": F.upper(F.col("x")[0]["confidence"])})
    texts = F.filter(F.transform("x", lambda p: p["clean"]), lambda t: t != "")
    group = group.withColumns({"texts": F.when(F.size(texts) > 0, texts).otherwise(F.transform("x", lambda p: F.trim(p["preview"]))), "words": F.when(F.size(texts) > 0, F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + F.size(T.tokens(t)))).otherwise(F.aggregate("x", F.lit(0).cast("long"), lambda s, p: s + p["word_count"]))})
    sides = group.select(book, "run_start", "first", "last").join(alignments.select(book, "scan_page", "pg_start", "pg_end"), book, "left").groupBy(book, "run_start").agg(F.max(F.when(F.col("scan_page") < F.col("first"), F.col("pg_end"))).alias("end"), F.min(F.when(F.col("scan_page") > F.col("last"), F.col("pg_start"))).alias("start"))
    met = group.join(sides, [book, "run_start"]).join(books.select(book, "body_text"), book, "left")
    many = F.col("first") < F.col("last")
    long = many | (F.col("words") >= LONG_GAP)
    name = F.when(many, F.concat(F.lit("Pages "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))).otherwise(F.concat(F.lit("Page "), F.col("first").cast("string")))
    body = F.when(many, F.array_join("texts", "\n\n")).otherwise(F.col("texts")[0])
    context = around(F.col("body_text"), F.col("end"), F.col("start"))
    lines = F.concat_ws("\n", F.concat(name, F.lit(" - "), F.when(long, "~").otherwise(""), F.col("words").cast("string"), F.lit(" words ["), F.col("level"), F.lit("]:")), F.when(long, F.concat(body, F.lit("\n"))).otherwise(F.concat(F.lit('Missing: "'), body, F.lit('"'))), F.when(context != "", context), F.lit(""))
    return holes.unionByName(met.select(F.col(book).alias("book_id"), F.lit(2).alias("section"), F.col("first").cast("long").alias("n"), lines.alias("text")))


def gap_counts(gaps: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, total, holes, verified_holes, uncovered, partial, high, medium, low) of a book's gaps."""
    is_hole = F.col("strategy") == "content_hole"
    kinds = {"holes": is_hole, "verified_holes": is_hole & F.col("pg_verified"), "uncovered": F.col("strategy") == "uncovered", "partial": F.col("strategy") == "partial", **{c: F.col("confidence") == c for c in ("high", "medium", "low")}}
    return gaps.groupBy(book).agg(F.count("*").alias("total"), *(F.count_if(t).alias(k) for k, t in kinds.items()))


def replacement_lines(found: DataFrame) -> DataFrame:
    """(pg_text, scan_text, occurrences, caught, text) of replacements without the signs around them, each pair once, by the alphabet."""
    clean = [F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_]+$", ""), r"^[^\p{L}\p{N}_']+", "") for c in ("pg_root", "scan_root")]
    own = found.withColumns({"a": clean[0], "b": clean[1]})
    first = F.min_by(F.struct("a", "b"), F.struct("pg_root", "scan_root"))
    out = own.groupBy(F.lower("a").alias("x"), F.lower("b").alias("y")).agg(first.alias("s"), F.max("occurrences").alias("occurrences"), F.max("caught").alias("caught"))
    return out.select(F.col("s.a").alias("pg_text"), F.col("s.b").alias("scan_text"), "occurrences", "caught", F.concat("s.a", F.lit(" ==> "), "s.b").alias("text")).orderBy(F.lower("pg_text"), "scan_text")


def comparison_report(variants: DataFrame, most: int = 50) -> DataFrame:
    """The comparison's lines per book: counts, categories, major variants in full, the first moderate ones and how many there are."""
    c = variants.groupBy("book_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("significance") == s).alias(s) for s in ("major", "moderate", "minor", "trivial")))
    head = F.concat(F.lit("## Summary\n\n- **"), thousands(F.col("total")), F.lit(" total variants** found\n- **"), thousands(F.col("major")), F.lit(" major** | "), thousands(F.col("moderate")), F.lit(" moderate | "), thousands(F.col("minor")), F.lit(" minor | "), thousands(F.col("trivial")), F.lit(" trivial\n"))
    lines = [c.select("book_id", F.lit(1).alias("section"), F.lit(0).cast("long").alias("n"), head.alias("text"))]
    kinds = variants.groupBy("book_id", "variant").agg(F.count("*").alias("k"))
    lines.append(kinds.select("book_id", F.lit(2).alias("section"), F.row_number().over(Window.partitionBy("book_id").orderBy("variant")).cast("long").alias("n"), F.concat(F.lit("| "), F.initcap(F.replace("variant", F.lit("_"), F.lit(" "))), F.lit(" | "), thousands(F.col("k")), F.lit(" |")).alias("text")))
    order = Window.partitionBy("book_id").orderBy("b_page", "seq")
    for section, level in ((3, "major"), (4, "moderate")):
        own = variants.filter(F.col("significance") == level).withColumn("n", F.row_number().over(order).cast("long")).withColumn("all", F.count("*").over(Window.partitionBy("book_id")))
        place = F.coalesce(F.col("b_page").cast("string"), F.lit("?"))
        if level == "major":
            text = F.concat(F.lit("### "), F.col("n").cast("string"), F.lit(". Page "), place, F.lit(" (confidence: "), percent(F.col("confidence")), F.lit(')\n- **A:** "'), F.col("pg_text"), F.lit('"\n- **B:** "'), F.col("scan_text"), F.lit('"\n'))
            lines.append(own.select("book_id", F.lit(section).alias("section"), "n", text.alias("text")))
        else:
            text = F.concat(F.lit("**"), F.col("n").cast("string"), F.lit(".** Page "), place, F.lit(': "'), F.col("pg_text"), F.lit('" → "'), F.col("scan_text"), F.lit('"'))
            shown = own.filter(F.col("n") <= most)
            lines.append(shown.select("book_id", F.lit(section).alias("section"), "n", text.alias("text")))
            rest = own.filter((F.col("n") == 1) & (F.col("all") > most)).select("book_id", F.lit(section).alias("section"), F.lit(most + 1).cast("long").alias("n"), F.concat(F.lit("\n... and "), (F.col("all") - most).cast("string"), F.lit(" more (see JSON for full list)")).alias("text"))
            lines.append(rest)
    return reduce(DataFrame.unionByName, lines)


def document(lines: DataFrame) -> DataFrame:
    """(book_id, text): a book's report as one text, in the order of sections and numbers."""
    return lines.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "n", "text"))), lambda x: x["text"]), "\n").alias("text"))

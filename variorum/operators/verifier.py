"""A verifier's answers as tables: requests out, JSON answers in, verdicts worked out from what was read."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: similarities from which a reading is a correction, an edition's variant, or unclear
CORRECTION, VARIANT = 0.8, 0.6
TOO_SHORT = 5
ANSWER = "struct<index:long,transcription:string,image_evidence:string,unable_to_verify:boolean>"


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio over characters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def derive(rows: DataFrame, text: str = "pg_text", read: str = "transcription") -> DataFrame:
    """Rows with verdict, confidence, reasoning and suggested_fix, from the book's text and what was read on the page.

    Only rows that differ by more than case or spaces are compared letter by letter.
    """
    a, b = _stripped(F.col(text)), _stripped(F.col(read))
    case = (b == "") | (F.lower(a) == F.lower(b))
    spaces = _squeezed(a) == _squeezed(b)
    own = rows.withColumn("__ratio", F.when(~case & ~spaces, similarity(a, b)))
    r = F.col("__ratio")
    share = F.concat(F.bround(r * 100, 0).cast("long").cast("string"), F.lit("% similar"))

    def kinds(same_case: object, same_spaces: object, correction: object, variant: object, other: object) -> Column:
        return F.when(case, same_case).when(spaces, same_spaces).when(r >= CORRECTION, correction).when(r >= VARIANT, variant).otherwise(other)

    return own.withColumns({
        "verdict": kinds("pg_correct", "pg_correct", "scan_correct", "edition_variant", "ambiguous"),
        "confidence": kinds(0.95, 0.9, 0.9, 0.8, 0.5),
        "reasoning": kinds(
            "Scan transcription matches PG text.",
            "Scan matches PG text (whitespace differences only).",
            F.concat(F.lit("Scan transcription differs from PG text ("), share, F.lit(").")),
            F.concat(F.lit("Scan differs from PG ("), share, F.lit("). Possible edition variant.")),
            F.concat(F.lit("Scan transcription substantially differs from PG ("), share, F.lit("). Possible misalignment.")),
        ),
        "suggested_fix": F.when(case | spaces, "").otherwise(b),
    }).drop("__ratio")


def answer_array(said: Column) -> Column:
    """The array of answers in a reply, as a whole, else in a fenced block, else the first brackets; null for none."""
    text = F.coalesce(said, F.lit(""))
    tries = [_stripped(text), F.regexp_extract(text, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1), F.regexp_extract(text, r"(?s)\[.*?\]", 0)]
    found = F.coalesce(*(F.from_json(F.when(x.startswith("["), x), f"array<{ANSWER}>") for x in tries))
    return F.when(F.size(found) > 0, found)


def answer_object(said: Column) -> Column:
    """The one answer in a reply; its fields are null where there is none.

    Where the reply as a whole has no field of an answer, a fenced block, then the
    first braces without nested ones are read.
    """

    def read(c: Column) -> Column:
        return F.from_json(F.when(c.startswith("{"), c), ANSWER)

    def known(x: Column) -> Column:
        return x["transcription"].isNotNull() | x["unable_to_verify"].isNotNull() | x["image_evidence"].isNotNull()

    text = F.coalesce(said, F.lit(""))
    tries = [read(_stripped(text)), read(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)), read(F.regexp_extract(text, r"(?s)\{[^}]+\}", 0))]
    return F.when(known(tries[0]), tries[0]).when(known(tries[1]), tries[1]).otherwise(tries[2])


UNREAD = "Verifier could not locate or transcribe passage."


def _told(rows: DataFrame, fault: Column, text: str) -> DataFrame:
    """Rows of answers with their verdicts; fault says why there is no answer."""
    unread = F.coalesce(F.col("unable_to_verify"), F.lit(False)) | (F.coalesce("transcription", F.lit("")) == "")
    why = F.coalesce(fault, F.when(unread, UNREAD))
    # only what was read goes on to be compared
    own = derive(rows.withColumn("__why", why).withColumn("transcription", F.when(F.col("__why").isNull(), F.col("transcription"))), text)
    none = F.col("__why").isNotNull()
    return own.withColumns({
        "verdict": F.when(none, "unable_to_verify").otherwise(F.col("verdict")),
        "confidence": F.when(none, 0.0).otherwise(F.col("confidence")),
        "reasoning": F.coalesce("__why", "reasoning"),
        "suggested_fix": F.when(none, "").otherwise(F.col("suggested_fix")),
        "image_evidence": F.coalesce("image_evidence", F.lit("")),
    }).drop("__why", "unable_to_verify")


def batch_verdicts(items: DataFrame, replies: DataFrame, batch: str = "batch_id", index: str = "item", text: str = "pg_text") -> DataFrame:
    """Items with transcription, image_evidence, verdict, confidence, reasoning, suggested_fix.

    items has (batch, index, text) and more, replies (batch, reply) with at most one
    row a batch; a reply is null where the request failed, and `failure`, if there is
    such a column, says why. Of several answers to one item the last one counts.
    """
    named = replies.withColumn("__answers", answer_array(F.col("reply")))
    broken = F.when(F.col("reply").isNull(), F.coalesce(F.col("failure"), F.lit("Empty API response")) if "failure" in replies.columns else F.lit("Empty API response"))
    state = named.select(F.col(batch).alias("__batch"), F.coalesce(broken, F.when(F.col("__answers").isNull(), "Could not parse JSON array response")).alias("__fault"), F.lit(True).alias("__there"))
    answers = named.select(F.col(batch).alias("__of"), F.posexplode("__answers").alias("__pos", "__a"))
    last = answers.filter("__a.index is not null").groupBy("__of", F.col("__a.index").alias("__item")).agg(F.max_by("__a", "__pos").alias("__a"))
    met = items.join(state, F.col(batch) == F.col("__batch"), "left").join(last, (F.col(batch) == F.col("__of")) & (F.col(index) == F.col("__item")), "left")
    fault = F.when(F.col("__there").isNull(), "Empty API response").otherwise(F.coalesce("__fault", F.when(F.col("__item").isNull(), "Missing result in batch response")))
    rows = met.withColumns({"__why_not": fault, **{c: F.col(f"__a.{c}") for c in ("transcription", "image_evidence", "unable_to_verify")}}).drop("__batch", "__fault", "__there", "__of", "__item", "__a")
    return _told(rows, F.col("__why_not"), text).drop("__why_not")


def single_verdicts(rows: DataFrame, text: str = "pg_text") -> DataFrame:
    """Rows with a reply each, as batch_verdicts has them."""
    answer = rows.withColumn("__a", answer_object(F.col("reply")))
    own = answer.withColumns({c: F.col(f"__a.{c}") for c in ("transcription", "image_evidence", "unable_to_verify")}).drop("__a")
    return _told(own, F.when(F.col("reply").isNull(), "Empty API response"), text).drop("reply")


def request(text: Column, context: Column) -> Column:
    """What a verifier is asked about one passage."""
    return F.concat(
        F.lit("Find the passage below on the image of the page and write down, sign by sign, what stands there.\n\nPassage: "), text, F.lit("\n"),
        F.when(F.length(F.trim(text)) < TOO_SHORT, "It is too short to be found: answer with unable_to_verify: true.\n").otherwise(""),
        F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Text around it: "), context, F.lit("\n"))).otherwise(""),
        F.lit("\nAnswer with a JSON object: transcription, image_evidence (20 signs or more from around it), unable_to_verify.\n"),
    )


def batch_requests(items: DataFrame, batch: str = "batch_id", index: str = "item", text: str = "pg_text", context: str = "context", most: int = 20) -> DataFrame:
    """(batch, part, request, n_items): the items of a page in requests of at most `most`."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy(index))
    one = F.concat(
        F.lit("Item "), F.col(index).cast("string"), F.lit(": "), F.col(text), F.lit("\n"),
        F.when(F.length(F.trim(F.col(text))) < TOO_SHORT, "Too short to be found: unable_to_verify: true.\n").otherwise(""),
        F.when(F.coalesce(F.col(context), F.lit("")) != "", F.concat(F.lit("Text around it: "), F.substring(context, 1, 200), F.lit("\n"))).otherwise(""),
    )
    dealt = items.withColumn("__part", F.floor((place - 1) / most).cast("long")).withColumn("__one", one)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, "__one"))), lambda x: x["__one"]), "\n")
    head = "Write down, sign by sign, what the page has in place of each passage below.\n\n"
    tail = "\nAnswer with a JSON array, an object an item: index, transcription, image_evidence (20 signs or more from around it), unable_to_verify.\n"
    return dealt.groupBy(batch, F.col("__part").alias("part")).agg(F.concat(F.lit(head), said, F.lit(tail)).alias("request"), F.count("*").alias("n_items"))

"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm import chat, decontaminate, fingerprint, html_extract, language, near_dedup, packing, pii, quality, substring_dedup
from variorum.runtime import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_text(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(table(spark, sf_dir, "pages"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            turns = chat.read_turns(x["formatted"])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(chat.read_loss(x["formatted"], x["loss"]))
            rows.append((x["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(x["formatted"])))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.format_chats(turns).mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.expr("filter(spans, x -> x.base)")

    def joined(spans: Column) -> Column:
        placed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, pii.TAGGED)), x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(placed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.expr(f"size(filter(spans, x -> x.base and x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_language": op6_language,
    "op7_html_extraction": op7_html_extraction,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
}

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

SQL: dict[str, str] = {
    "op10_decontamination": f"""
        WITH items AS (
          SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
        ), item_shingles AS (
          SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS shingle FROM items
        ), sizes AS (
          SELECT item_id, k, count(*) AS n FROM item_shingles GROUP BY ALL
        ), docs AS (
          SELECT doc_id, {_WORDS} AS w FROM documents
        ), doc_shingles AS (
          SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS shingle
          FROM docs, (SELECT DISTINCT k FROM sizes) WHERE len(w) >= k
        )
        SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
        FROM doc_shingles JOIN item_shingles USING (k, shingle) JOIN sizes USING (item_id, k)
        GROUP BY doc_id, item_id, n HAVING count(*) * 5 >= n * 4
    """,
}

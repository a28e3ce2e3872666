"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents. The classifier and the tagger aren't SQL, so there is no SQL
for the whole; tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm import decontaminate, near_dedup, packing, pii, quality
from variorum.llm.queries import tokenizer_path
from variorum.runtime import attach, cut, table

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer doesn't reject.

    Null, empty and blank texts score 0 and go. Repeated rows have one score and stay
    or go together. No row, no result.
    """
    attach(spark)
    return quality.score(docs).filter("quality_keep").select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, five-word shingles at 0.8, the document of smallest id.

    Where ids repeat, rows of equal id and text are one, and each text is a document
    of its own, of which a component keeps the one of smallest id, then of least text
    hash: a text isn't dropped for another one of its id. Rows with a null id are kept,
    and so are null and empty texts, which are like nothing.
    """
    attach(spark)
    found = cut(near_dedup.near_duplicates(docs))
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.join(found.filter("not kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    own = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
    own = cut(own.withColumn("__row", F.monotonically_increasing_id()))
    parts = near_dedup.near_duplicates(own, "__row").select("__row", "component_id")
    named = own.select("__row", F.struct("doc_id", F.xxhash64("text"), "__row").alias("first")).join(parts, "__row")
    kept = named.groupBy("component_id").agg(F.min("first")["__row"].alias("__row")).select("__row")
    return own.join(kept, "__row", "left_semi").select(docs.columns).unionByName(docs.filter("doc_id is null"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, and rows with a null id stay. Rows that repeat an
    id go together, where one of them holds an item.
    """
    attach(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars is that of the new text.

    Null texts stay null, as does their n_chars; each row stands for itself, whatever
    its id, so that repeated rows and null ids stay.
    """
    attach(spark)
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A null or empty text is the end's id alone. Repeated rows are packed as often as
    they occur, and null ids like any other.
    """
    attach(spark)
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("personal_data", without_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

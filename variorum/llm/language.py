"""Language of web pages by Bayesian fusion of text, markup, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.llm.quality import bounded_sample
from variorum.llm.words import blocks
from variorum.runtime import cut

DIMS = 1 << 16
TRAIN_TEXTS = 2000
#: How far a page's text may go towards certainty, in nats for a character trigram and at most.
TEMPER, MOST = 0.2, 30.0
#: Pseudo-counts: votes that a level of the hierarchy takes from the level above it.
BORROW = 4.0


def _trigrams(data: np.ndarray) -> np.ndarray:
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    h = low.astype(np.uint32)
    if h.size < 3:
        return np.zeros(0, np.int64)
    return ((h[:-2] * np.uint32(0x9E3779B1) ^ h[1:-1] * np.uint32(0x85EBCA6B) ^ h[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int64)


class TextModel:
    """Log chances of hashed character trigrams in each language."""

    def __init__(self, languages: list[str], log_chance: np.ndarray):
        self.languages, self.log_chance = languages, log_chance

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Log likelihoods (texts, languages), tempered, with the best at 0."""
        grams = _trigrams(data)
        total = np.zeros((grams.size + 1, len(self.languages)))
        np.cumsum(self.log_chance[grams], axis=0, out=total[1:])
        end = np.maximum(offs[:-1], np.minimum(offs[1:] - 2, grams.size))
        start = np.minimum(offs[:-1], grams.size)
        out = (total[np.maximum(start, end)] - total[start]) * TEMPER
        return np.maximum(out - out.max(1, keepdims=True), -MOST)


def fit_text(labelled: DataFrame, text_col: str = "text", language_col: str = "lang", id_col: str = "doc_id", train_texts: int = TRAIN_TEXTS) -> TextModel:
    """A model fitted on at most train_texts labelled texts, drawn by a hash of their id.

    Languages are those of the drawn texts; null languages and texts aren't drawn.
    """
    own = labelled.select(F.col(language_col).alias("language"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(31)).alias("draw"))
    drawn = bounded_sample(own.filter("language is not null and text is not null"), train_texts).select("language", "text").toPandas()
    languages = sorted(drawn["language"].unique())
    if not languages:
        return TextModel(["und"], np.zeros((DIMS, 1)))
    counts = np.zeros((len(languages), DIMS))
    for language, text in zip(drawn["language"], drawn["text"], strict=True):
        counts[languages.index(language)] += np.bincount(_trigrams(np.frombuffer(text.encode(), np.uint8)), minlength=DIMS)
    chance = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * DIMS)
    return TextModel(languages, np.log(chance).T.copy())


def _scorer(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.score(data, offs) for _, data, offs in blocks(batch.column(0))]
            scores = np.concatenate(rows) if rows else np.zeros((0, len(model.languages)))
            offs = pa.array(np.arange(0, scores.size + 1, len(model.languages)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(offs, pa.array(scores.ravel()))], names=[*batch.schema.names[1:], "likelihood"])

    return run


def _softmax(terms: str) -> Column:
    return F.expr(f"transform({terms}, x -> exp(x - array_max({terms})) / aggregate({terms}, 0D, (s, y) -> s + exp(y - array_max({terms}))))")


def visible_text(html: Column) -> Column:
    """The text of a page without head, scripts, styles, comments and tags."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(head|script|style)\b.*?(</\1\s*>|$)|<!--.*?(-->|$)", " ")
    return F.regexp_replace(bare, r"<[^>]*>?", " ")


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, lang, confidence, declared, suffix, host, text_lang, posterior), a row per page.

    Four kinds of evidence are taken as independent given the language: the text's
    likelihood; the language that the markup declares; the address's suffix; the
    host. The chances of a declaration and of a suffix in each language, and the
    shares of languages of a host, of its domain and of all pages, are sums of the
    texts' posteriors over all pages, grouped before they are joined back. A host's
    shares borrow from its domain's, these from all. A page's own vote is taken out
    of its host's and domain's counts.

    Null and empty pages have a flat likelihood and go by the rest; null or odd
    addresses have the host ''. Pages without a declaration have the declaration
    ''. Repeated rows are separate pages. Other columns are not read.
    """
    n = len(model.languages)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    declared = F.lower(F.coalesce(F.regexp_extract(F.col(html_col), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1), F.lit("")))
    own = pages.select(visible_text(F.col(html_col)).alias("body"), F.col(id_col).alias("id"), host.alias("host"), declared.alias("declared"))
    own = own.withColumns({"suffix": F.regexp_extract("host", r"([^.]*)$", 1), "domain": F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)})
    kind = dict(own.dtypes)["id"]
    scored = own.mapInArrow(_scorer(model), f"id {kind}, host string, declared string, suffix string, domain string, likelihood array<double>")
    # one row of figures a page, read six times below: pages are gone through once
    scored = cut(scored.withColumn("vote", _softmax("likelihood")))

    def sums(key: str, name: str) -> DataFrame:
        return scored.groupBy(key).agg(F.array(*(F.sum(F.col("vote")[k]) for k in range(n))).alias(name))

    total = scored.agg(F.array(*(F.coalesce(F.sum(F.col("vote")[k]), F.lit(0.0)) for k in range(n))).alias("total")).first()["total"]
    overall = [(x + 1) / (sum(total) + n) for x in total]
    joined = scored
    for key in ("declared", "suffix", "domain", "host"):
        joined = joined.join(sums(key, f"of_{key}"), key, "left")
    base, size = F.lit(overall), F.lit([float(x) for x in total])
    joined = joined.withColumns({"overall": base, "size": size})

    def shares(counts: str, above: str) -> Column:
        return F.expr(f"transform(sequence(0, {n - 1}), k -> greatest(({counts}[k] - vote[k] + {BORROW} * {above}[k]) / (aggregate({counts}, 0D, (s, y) -> s + y) - 1 + {BORROW}), 1e-6D))")

    joined = joined.withColumn("domain_share", shares("of_domain", "overall")).withColumn("host_share", shares("of_host", "domain_share"))
    log = F.expr(f"transform(sequence(0, {n - 1}), k -> likelihood[k] + ln(host_share[k]) + ln((of_declared[k] - vote[k] + 0.5D) / (size[k] - vote[k] + 1D)) + ln((of_suffix[k] - vote[k] + 0.5D) / (size[k] - vote[k] + 1D)))")
    joined = joined.withColumn("evidence", log).withColumn("posterior", _softmax("evidence"))
    names = F.lit(model.languages)

    def best(column: str) -> Column:
        return F.get(names, F.array_position(F.col(column), F.array_max(column)).cast("int") - 1)

    return joined.select(F.col("id").alias(id_col), best("posterior").alias("lang"), F.array_max("posterior").alias("confidence"), "declared", "suffix", "host", best("vote").alias("text_lang"), "posterior")

"""Quality: overlapping heuristic labellers, EM over their votes, a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.words import blocks, rolling, word_hashes

DIMS = 1 << 14
TRAIN_DOCS = 3000
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?!/")
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_STOPS = b".,;:?!"

ABSTAIN = 2


def measures(text: bytes, hashes: np.ndarray) -> np.ndarray | None:
    """What the labellers look at; None for a text without words."""
    words = text.split()
    if not words:
        return None
    n = len(text)
    letters = n - len(text.translate(None, _LETTERS))
    counts = Counter(words)
    runs = rolling(hashes, 5)
    ends = sum(c for w, c in counts.items() if w[-1] in b".?!")
    return np.array(
        [
            (n - len(text.translate(None, _SYMBOLS))) / n,
            (n - len(text.translate(None, _UPPER))) / max(1, letters),
            counts.most_common(1)[0][1] / len(words),
            1 - np.unique(runs).size / runs.size if runs.size else 0.0,
            counts.get(b"|", 0) / len(words),
            ends / len(words),
            letters / sum(map(len, words)),
            sum(c for w, c in counts.items() if w[-2:-1] == w[-1:] and w[-1:] in (b"!", b"*", b"#", b"%", b"&", b"$")) / len(words),
            float((hashes[1:] == hashes[:-1]).mean()) if hashes.size > 1 else 0.0,
            len(counts) / len(words),
            len(words),
        ]
    )


#: Per labeller its measure, the range it calls bad, and the range it calls good; between them it has no vote.
RULES = (
    (0, (0.08, 1), (0, 0.04)),
    (1, (0.5, 1), (0, 0.4)),
    (2, (0.3, 1), (0, 0.2)),
    (3, (0.6, 1), (0, 0.5)),
    (4, (0.1, 1), (0, 0.05)),
    (5, (0, 0.005), (0.02, 1)),
    (6, (0, 0.5), (0.7, 1)),
    (7, (0.3, 1), (0, 0.1)),
    (8, (0.2, 1), (0, 0.1)),
    (9, (0, 0.03), (0.2, 1)),
)
#: Measures that say nothing of a text with fewer words than this.
SHORT, IN_SHORT = 20, (2, 3, 5, 8, 9)


def votes(m: np.ndarray | None) -> list[int]:
    """1 good, 0 bad, 2 no vote, of each labeller."""
    if m is None:
        return [ABSTAIN] * len(RULES)
    out = []
    for k, bad, good in RULES:
        if k in IN_SHORT and m[-1] < SHORT:
            out.append(ABSTAIN)
        else:
            out.append(0 if bad[0] <= m[k] <= bad[1] else 1 if good[0] <= m[k] <= good[1] else ABSTAIN)
    return out


def posterior(patterns: np.ndarray, chance: np.ndarray, share: float) -> np.ndarray:
    """The chance that texts with these votes are good."""
    odds = np.append(np.log(chance[:, 1] / chance[:, 0]), np.zeros((len(chance), 1)), 1)
    logit = np.log(share / (1 - share)) + sum(odds[k][patterns[:, k]] for k in range(patterns.shape[1]))
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Each labeller's chance of each vote on bad and on good texts, and the share of good ones.

    Expectation-maximisation (Dawid, Skene, 1979) over a row of votes per distinct
    pattern; no vote says nothing. It starts from the votes themselves: a fault
    found outweighs faults not found.
    """
    post = np.where((patterns == 0).any(1), 0.05, 0.95)
    for _ in range(rounds):
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.001, 0.999))
        weight = np.stack([(1 - post) * counts, post * counts])
        chance = np.stack([(weight @ (patterns == v)).T for v in (0, 1)], 2) + 0.1
        chance /= chance.sum(2, keepdims=True)
        new = posterior(patterns, chance, share)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return chance, share


def hashed_features(data: np.ndarray, offs: np.ndarray, seen: list[np.ndarray | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the hashed features and their values: byte trigrams, and the measures in steps."""
    h = data.astype(np.uint32)
    tri = np.zeros(0, np.int64)
    if h.size >= 3:
        tri = (((h[:-2] * 0x9E3779B1 + h[1:-1] * 0x85EBCA6B + h[2:] * 0xC2B2AE35) ^ (h[:-2] << 7)).astype(np.uint32) >> 18).astype(np.int64)
    for i, m in enumerate(seen):
        counts = np.bincount(tri[offs[i] : max(offs[i], offs[i + 1] - 2)], minlength=DIMS)
        at = np.flatnonzero(counts)
        value = np.log1p(counts[at])
        value /= max(1e-9, np.sqrt((value * value).sum()))
        steps = [] if m is None else [(k * 7919 + int(min(20, x * 20)) * 104729 + 17) % DIMS for k, x in enumerate(m[:-1])]
        yield np.append(at, steps).astype(np.int64), np.append(value, np.full(len(steps), 0.5))


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]]:
    for _, data, offs in blocks(column):
        h, at = word_hashes(data, offs, False)
        raw = data.tobytes()
        yield data, offs, [measures(raw[offs[i] : offs[i + 1]], h[at[i] : at[i + 1]]) for i in range(offs.size - 1)]


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [sum(v * 3**k for k, v in enumerate(votes(m))) for _, _, seen in _texts(batch.column(0)) for m in seen]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["pattern"])


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, values, pattern = [], [], []
        for data, offs, seen in _texts(batch.column(0)):
            for at, value in hashed_features(data, offs, seen):
                rows.append(at.astype(np.int32).tobytes())
                values.append(value.astype(np.float32).tobytes())
            pattern += [sum(v * 3**k for k, v in enumerate(votes(m))) for m in seen]
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int32()), pa.array(rows, pa.binary()), pa.array(values, pa.binary())], names=["pattern", "at", "value"])


def _unpack(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3**k % 3 for k in range(len(RULES))], 1)


class Scorer:
    """The labellers' fitted chances and the linear scorer trained on their posterior labels."""

    def __init__(self, chance: np.ndarray, share: float, weights: np.ndarray, bias: float):
        self.chance, self.share, self.weights, self.bias = chance, share, weights, bias

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip((self.weights[at] * value).sum() + self.bias, -50, 50))))


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """The `most` rows of least draw; only draws are put in order over all rows, the rest travels for those alone."""
    last = rows.select("draw").orderBy("draw").limit(most).agg(F.max("draw")).first()[0]
    kept = rows.filter(F.col("draw") <= F.lit(last)) if last is not None else rows.filter("false")
    return kept.orderBy("draw", "text").limit(most)


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, epochs: int = 30) -> Scorer:
    """A scorer fitted without reviewers' labels.

    EM reads the votes on all texts, counted by pattern: at most 3**labellers rows
    reach the driver. The scorer is trained on train_docs texts, drawn by a hash of
    their id, each with its posterior as label. A table without words gives a
    scorer that scores by the prior.
    """
    own = docs.select(F.col(text_col).alias("text"))
    found = own.mapInArrow(_voter, "pattern int").groupBy("pattern").count().toPandas().sort_values("pattern")
    silent = sum(ABSTAIN * 3**k for k in range(len(RULES)))
    found = found[found.pattern != silent]
    if not len(found):
        return Scorer(np.full((len(RULES), 2, 2), 0.5), 0.5, np.zeros(DIMS), 0.0)
    chance, share = fit_votes(_unpack(found.pattern.to_numpy()), found["count"].to_numpy().astype(float))
    drawn = bounded_sample(docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(29)).alias("draw")).filter("text is not null"), train_docs)
    sample = drawn.select("text").mapInArrow(_featurer, "pattern int, at binary, value binary").toPandas()
    labels = posterior(_unpack(sample.pattern.to_numpy()), chance, share)
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(sample["at"], sample["value"], strict=True)]
    w, g, bias, bias_g = np.zeros(DIMS), np.full(DIMS, 1e-6), 0.0, 1e-6
    # posterior labels are lopsided; either side weighs the same in all
    side = np.array([1 / max(1e-9, (1 - labels).sum()), 1 / max(1e-9, labels.sum())]) * len(labels) / 2
    side = np.clip(side, 0.2, 5)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, value = rows[k]
            p = 1 / (1 + np.exp(-np.clip((w[at] * value).sum() + bias, -50, 50)))
            err = (1 - labels[k]) * side[0] * p - labels[k] * side[1] * (1 - p)
            step = err * value + 1e-5 * w[at]
            g[at] += step * step
            w[at] -= 0.2 * step / np.sqrt(g[at])
            bias_g += err * err
            bias -= 0.2 * err / np.sqrt(bias_g)
    return Scorer(chance, share, w, bias)


def _scorer(model: Scorer, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            post, score = [], []
            for data, offs, seen in _texts(batch.column(text_at)):
                post += posterior(np.array([votes(m) for m in seen]), model.chance, model.share).tolist()
                for m, (at, value) in zip(seen, hashed_features(data, offs, seen), strict=True):
                    score.append(0.0 if m is None else model.score(at, value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(post, pa.float64()), pa.array(score, pa.float64())], names=[*batch.schema.names, "quality_posterior", "quality_score"])

    return run


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.2, model: Scorer | None = None) -> DataFrame:
    """docs with quality_posterior, quality_score and quality_keep (score at or above threshold).

    The threshold is low: what is hard to tell, such as a text of a few words, is kept.
    The posterior is what the labellers say, the score what the linear scorer says.
    Null, empty and blank texts score 0. Columns of these names are replaced; all
    other columns and repeated rows stay as they are.
    """
    model = model or fit(docs, text_col, id_col)
    own = docs.drop("quality_posterior", "quality_score", "quality_keep")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    scored = own.mapInArrow(_scorer(model, own.columns.index(text_col)), f"{schema}, quality_posterior double, quality_score double")
    return scored.withColumn("quality_keep", F.col("quality_score") >= threshold)

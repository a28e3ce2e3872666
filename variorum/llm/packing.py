"""Packing token sequences: first-fit decreasing over a tournament tree, in random groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_DOCS = 2048
SLIVER = 16
_CACHE_WORDS = 800_000
_TOGETHER = 128
#: A control character that is one token by itself stands between words that are encoded together.
_MARK = b"\x1f"
_LONG = 1 << 22


class Bins:
    """Bins in the order they were opened; a tournament tree finds the first with enough room."""

    def __init__(self, most: int, capacity: int):
        self.size = 1
        while self.size < max(1, most):
            self.size *= 2
        self.room = [0] * self.size + [capacity] * self.size
        for i in range(self.size - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def first_fit(self, length: int) -> int:
        """The first bin with room for length, which is taken from it."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < length:
                i += 1
        room[i] -= length
        found = i - self.size
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return found


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, bin, offset) of documents with these lengths.

    A document is cut at each full sequence; what is left of it is placed first-fit
    in decreasing order, ties by position. Then the emptiest bins are dealt out to
    the gaps of the others, as far as these hold them.
    """
    pieces, rest = [], []
    bins = 0
    for d, n in enumerate(lengths):
        for s in range(0, n - n % capacity, capacity):
            pieces.append((d, s, capacity, bins, 0))
            bins += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Bins(len(rest), capacity)
    held: dict[int, list[tuple[int, int, int]]] = {}
    for n, d, s in rest:
        held.setdefault(tree.first_fit(n), []).append((d, s, n))
    load = {b: sum(n for _, _, n in x) for b, x in held.items()}
    gaps = sorted((capacity - v, b) for b, v in load.items() if capacity - v >= SLIVER)
    spare = sum(g for g, _ in gaps)
    while len(gaps) > 1:
        gap, b = gaps[-1]
        if load[b] > spare - gap:
            break
        gaps.pop()
        spare -= gap + load.pop(b)
        for d, s, n in held.pop(b):
            while n:
                g, to = gaps[0]
                k = min(n, g)
                held[to].append((d, s, k))
                load[to] += k
                s, n = s + k, n - k
                if k == g:
                    gaps.pop(0)
                else:
                    gaps[0] = (g - k, to)
        gaps = sorted((capacity - load[x], x) for _, x in gaps if capacity - load[x] >= SLIVER)
        spare = sum(g for g, _ in gaps)
    for b in sorted(held):
        at = 0
        for d, s, n in held[b]:
            pieces.append((d, s, n, bins, at))
            at += n
        bins += 1
    return pieces


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class WordTokenizer:
    """Encodes texts word by word, remembering words; for tokenizers that drop white space.

    ASCII white space parts what such a tokenizer reads, so that a text's ids are
    those of its words in order.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        self.folds = all(self.encoder.encode(x, add_special_tokens=False).ids == self.encoder.encode(x.lower(), add_special_tokens=False).ids for x in ("Aa bB", "QUEUE", "IJ'LL Y'S"))
        alone = self.encoder.encode(_MARK.decode(), add_special_tokens=False).ids
        self.mark = alone[0] if len(alone) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.ids = np.zeros(0, self.dtype)
        self.starts = np.zeros(1, np.int64)

    def encode(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.fresh:
            got, lens = self._encode_apart(self.number.fresh)
            self.number.fresh = []
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lens)])
            self.ids = np.concatenate([self.ids, got])
        begin, lens = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(words) else 0
        return self.ids[np.repeat(begin - ends + lens, lens) + np.arange(total)], ends

    def _encode_apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and how many each has."""
        odd = [k for k, w in enumerate(words) if _MARK in w]
        if self.mark is None or odd:
            got = [x.ids for x in self.encoder.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
            return np.fromiter((i for x in got for i in x), self.dtype), np.array([len(x) for x in got])
        between = b" " + _MARK + b" "
        runs = [(between.join(words[i : i + _TOGETHER]) + between).decode("utf-8", "replace") for i in range(0, len(words), _TOGETHER)]
        got = [np.array(x.ids, self.dtype) for x in self.encoder.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate(got)
        marks = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(np.append(-1, marks)) - 1

    def batch(self, texts: list[bytes], eos: int) -> Iterator[np.ndarray]:
        """The ids of each text, then eos."""
        tail = np.array([eos], self.dtype)
        i = 0
        while i < len(texts):
            words, counts, size = [], [], 0
            while i < len(texts) and size < _LONG:
                # case is folded by the tokenizer; folding A-Z here makes fewer words, but could make a special token
                own = (texts[i].lower() if self.folds and b"<|" not in texts[i] else texts[i]).split()
                words += own
                counts.append(len(own))
                size += len(texts[i])
                i += 1
            ids, ends = self.encode(words)
            at = 0
            begin = 0
            for n in counts:
                at += n
                end = int(ends[at - 1]) if at else 0
                yield np.concatenate([ids[begin:end], tail])
                begin = end
            if len(self.number) > _CACHE_WORDS:
                self.clear()


_made: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]


def _encoder(path: str, eos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [b"" if x is None else x for x in part.column(1).cast(pa.binary()).to_pylist()]
                ids = [x.tobytes() for x in encode.batch(texts, eos)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ids, pa.binary())], names=["id", "grp", "ids"])

    return run


def _packer(capacity: int, path: str):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        dtype = _tokenizer(path).dtype
        group = group.sort_by([("id", "ascending"), ("ids", "ascending")])
        docs = [np.frombuffer(x.as_buffer(), dtype) for x in group.column("ids")]
        pieces = pack_lengths([len(x) for x in docs], capacity)
        d, start, length, seq, at = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        base = key[0].as_py() << 32
        return pa.table(
            {
                "id": group.column("id").combine_chunks().take(pa.array(d)),
                "start": start,
                "length": length,
                "ids": pa.array([docs[a][b : b + c].astype("<u4").tobytes() for a, b, c, _, _ in pieces], pa.binary()),
                "doc_tokens": np.array([len(docs[a]) for a in d], np.int64),
                "sequence_id": base + seq,
                "offset": at,
            }
        )

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, eos: int = 1, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset): one row per piece.

    tokenizer is the path of a tokenizer file whose tokenizer drops white space.
    ids has the piece's token ids as little-endian unsigned 32-bit numbers. Groups
    hold about group_docs documents drawn by a hash of the id and the row's place, so
    their number grows with the table, and none grows with a source, a run of copies
    or an id on many rows. Rows of files and checkpoints have fixed places, so that a
    task that runs again deals as before.

    A null or empty text is the id eos alone. A repeated row is packed as often as
    it occurs; a null id is packed like any other. No row, no piece. Other columns
    are not read.
    """
    groups = max(1, -(-docs.count() // group_docs))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    place = F.xxhash64("id", F.monotonically_increasing_id())
    dealt = own.withColumn("grp", F.pmod(place, F.lit(groups)).cast("long"))
    ids = dealt.mapInArrow(_encoder(tokenizer, eos), "id long, grp long, ids binary")
    out = ids.groupBy("grp").applyInArrow(_packer(capacity, tokenizer), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)

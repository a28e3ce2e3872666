"""Substring dedup: suffix automata of reference shards, documents streamed through them.

The reference of a corpus is the corpus, so no automaton of all of it can be sent
to every executor. Instead every window of words has an anchor, the run of
ANCHOR_WORDS words in it with the least hash; equal windows have equal anchors.
What surrounds an anchor goes to the shard of its hash, and there the reference
passages are made into suffix automata, and the passages of all documents are
streamed through them for their matching statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.words import blocks, mix, rolling, word_hashes
from variorum.runtime import parallelism

_U = np.uint64
ANCHOR_WORDS = 8
GROUP_BYTES = 8_000_000
SHARD_WORDS = 30_000
#: the windows of an anchor that more runs have go by a hash of their own
HOT_RUNS = 1000
#: Hashes travel as their low 40 bits; those that meet are of one shard or one anchor.
_LOW = _U((1 << 40) - 1)


class SuffixAutomaton:
    """Of word sequences, with the smallest document of each state; add them by ascending document."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, first: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _part(self, p: int, q: int, word: int) -> int:
        """The state of p's longest sequence and word, made out of q if q also has longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.first[q], self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._part(last, q, word)
                continue
            new = self._state(self.length[last] + 1, doc, 0, {})
            p, last = last, new
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._part(p, self.next[p][word], word)

    def matches(self, words: list[int], least: int) -> list[int]:
        """For each word the smallest document with the `least` words that end there; -1 for fewer matching words."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        out, state, held = [], 0, 0
        for word in words:
            while state and word not in nexts[state]:
                state = link[state]
                held = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                held += 1
            while link[state] >= 0 and length[link[state]] >= least:
                state = link[state]
                held = length[state]
            out.append(first[state] if held >= least else -1)
        return out


def _windows(texts: pa.ChunkedArray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of rows (first row, word hashes, where rows start, the anchor of the window that starts at each word)."""
    for row, data, offs in blocks(texts):
        h, at = word_hashes(data, offs, False)
        grams = mix(rolling(h, ANCHOR_WORDS) ^ _U(0x5851F42D4C957F2D))
        spread = window - ANCHOR_WORDS + 1
        n = grams.size - spread + 1
        anchors = np.zeros(0, _U)
        if n > 0:
            anchors = grams[:n].copy()
            for i in range(1, spread):
                np.minimum(anchors, grams[i : i + n], out=anchors)
        yield row, h, at, anchors


def _runs(at: np.ndarray, anchors: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one row with one anchor: the row, the first window and how many."""
    rows = np.repeat(np.arange(at.size - 1), np.diff(at))[: anchors.size]
    starts = np.arange(anchors.size)
    inside = starts + window <= at[rows + 1]
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(head)
    stop = np.append(first[1:], anchors.size)
    total = np.append(0, np.cumsum(inside))
    return rows[first], first, total[stop] - total[first]


def _five(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)[:, :5]


def _from_five(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for x in column:
        own = np.zeros((len(x.as_buffer()) // 5, 8), np.uint8)
        own[:, :5] = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 5)
        out.append(own.view(_U).ravel())
    return out


def _sorted_group(group: pa.Table) -> pa.Table:
    return group.sort_by([("id", "ascending"), ("text", "ascending")])


def _pack(bucket: np.ndarray, grp: int, *columns: np.ndarray) -> pa.Table:
    """One row a shard with the bytes of each column's values that belong to it."""
    order = np.argsort(bucket, kind="stable")
    used, starts = np.unique(bucket[order], return_index=True)
    cuts = np.append(starts, bucket.size)
    out = {"shard": pa.array(used, pa.int32()), "grp": pa.array([grp] * used.size, pa.int64())}
    for k, c in enumerate(columns):
        c = c[order]
        out[f"c{k}"] = pa.array([c[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
    return pa.table(out)


def _shard_of(anchors: np.ndarray, shards: int) -> np.ndarray:
    return (((anchors >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def _anchors(window: int, shards: int, hot_runs: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = _sorted_group(group)
        found, docs = [], []
        for row, _, at, anchors in _windows(group.column("text"), window):
            rows, first, _ = _runs(at, anchors, window)
            found.append(anchors[first])
            docs.append(rows + row)
        a, d = (np.concatenate(x) if x else np.zeros(0, _U) for x in (found, docs))
        # equal neighbours are of one row; of an anchor the least and greatest row tell whether several have it
        order = np.argsort(a, kind="stable")
        a, d = a[order], d[order].astype(np.int64)
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if a.size else np.zeros(0, np.int64)
        several = np.maximum.reduceat(d, head) > np.minimum.reduceat(d, head) if a.size else np.zeros(0, bool)
        runs = np.diff(np.append(head, a.size))
        return _pack(_shard_of(a[head], shards), key[0].as_py(), _five(a[head]), (np.minimum(runs, hot_runs + 1) * 2 + several).astype(np.uint32))

    return run


def _shared(hot_runs: int):
    def run(key: tuple, shard: pa.Table) -> pa.Table:
        """Of each group's anchors those that several documents have, and whether they are hot ones."""
        parts = _from_five(shard.column("c0"))
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in shard.column("c1")])
        a = np.concatenate(parts)
        _, code, count = np.unique(a, return_inverse=True, return_counts=True)
        kept = ((count > 1) | (np.bincount(code, counts & 1) > 0))[code]
        hot = (np.bincount(code, counts >> 1) > hot_runs)[code].astype(np.uint8)
        at = np.cumsum([0, *map(len, parts)])
        pieces = [slice(i, j) for i, j in zip(at, at[1:], strict=False)]
        return pa.table({"grp": shard.column("grp"), "shard": shard.column("shard"), "anchors": pa.array([_five(a[x][kept[x]]).tobytes() for x in pieces], pa.binary()), "hot": pa.array([hot[x][kept[x]].tobytes() for x in pieces], pa.binary())})

    return run


def _sequence_keys(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of words."""
    power = np.arange(int(size.max()) if size.size else 0)
    cells = np.repeat(first, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    within = cells - np.repeat(first, size)
    salt = mix(power.astype(_U) + _U(0x1234567))
    begins = np.cumsum(size) - size
    return mix(np.add.reduceat(mix(h[cells] ^ salt[within]), begins) + size.astype(_U)) if size.size else np.zeros(0, _U)


def _candidates(texts: pa.ChunkedArray, replies: pa.Table, window: int, shards: int):
    """The passages around shared anchors: (row, words, rows' starts, run rows, first words, windows, anchors).

    Of a hot anchor each window is a passage of its own, with its own hash for an anchor:
    equal windows still meet, but not all that stands around the anchor.
    """
    known = replies.filter(pc.is_valid(replies.column("anchors")))
    shared = [x | _U(n << 40) for n, x in zip(known.column("shard").to_pylist(), _from_five(known.column("anchors")), strict=True)]
    shared = np.concatenate([np.zeros(0, _U), *shared])
    hot = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for x in known.column("hot"))]) > 0
    order = np.argsort(shared, kind="stable")
    shared, hot = shared[order], hot[order]
    for row, h, at, anchors in _windows(texts, window):
        rows, first, size = _runs(at, anchors, window)
        own = anchors[first]
        if shared.size:
            named = (own & _LOW) | (_shard_of(own, shards).astype(_U) << _U(40))
            place = np.minimum(np.searchsorted(shared, named), shared.size - 1)
            keep = shared[place] == named
            apart = hot[place[keep]]
        else:
            keep, apart = np.zeros(own.size, bool), np.zeros(0, bool)
        rows, first, size, own = rows[keep], first[keep], size[keep], own[keep]
        if apart.any():
            pieces = np.where(apart, size, 1)
            which = np.repeat(np.arange(size.size), pieces)
            within = np.arange(which.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            apart, rows, first, size, own = apart[which], rows[which], first[which] + within, np.where(apart, 1, size)[which], own[which]
            own[apart] = _sequence_keys(h, first[apart], np.full(int(apart.sum()), window))
        yield row, h, at, rows, first, size, own


def _passages(window: int, shards: int):
    def run(key: tuple, group: pa.Table, replies: pa.Table) -> pa.Table:
        group = _sorted_group(group)
        ids = group.column("id").to_numpy()
        seen: list[tuple[np.ndarray, ...]] = []
        words = []
        for row, h, _, rows, first, size, own in _candidates(group.column("text"), replies, window, shards):
            size = size + window - 1
            keys = _sequence_keys(h, first, size)
            cells = np.repeat(first, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
            seen.append((keys, own, ids[rows + row], size))
            words.append(h[cells])
        if not seen:
            return _pack(np.zeros(0, np.int64), 0, *([np.zeros(0, _U)] * 5))
        keys, own, docs, size = (np.concatenate(x) for x in zip(*seen, strict=True))
        h = np.concatenate(words)
        # one passage for each sequence, with its smallest document; ids ascend
        _, pick = np.unique(keys, return_index=True)
        pick = np.sort(pick)
        begin = np.cumsum(size) - size
        cells = np.repeat(begin[pick], size[pick]) + (np.arange(int(size[pick].sum())) - np.repeat(np.cumsum(size[pick]) - size[pick], size[pick]))
        shard = _shard_of(own[pick], shards)
        table = _pack(shard, key[0].as_py(), keys[pick], own[pick], docs[pick], size[pick].astype(np.uint32))
        return table.append_column("c4", _pack(np.repeat(shard, size[pick]), 0, _five(h[cells])).column("c0"))

    return run


def _match(window: int):
    def run(key: tuple, shard: pa.Table) -> pa.Table:
        """For each group and passage whether a document before the group's first with it has each of its windows."""
        keys, own, docs, size = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in shard.column(f"c{k}")]) for k, t in enumerate((_U, _U, np.int64, np.uint32)))
        size, h = size.astype(np.int64), np.concatenate(_from_five(shard.column("c4")))
        group = np.repeat(np.arange(shard.num_rows), [len(x.as_buffer()) // 8 for x in shard.column("c0")])
        begin = np.cumsum(size) - size
        order = np.lexsort((docs, keys))
        head = np.append(True, keys[order][1:] != keys[order][:-1]) if keys.size else np.zeros(0, bool)
        code = np.empty(keys.size, np.int64)
        code[order] = np.cumsum(head) - 1
        one = order[head]  # of each distinct sequence the passage of the smallest document
        found: list[list[int]] = [[] for _ in one]
        by_anchor = np.argsort(own[one], kind="stable")
        at = 0
        while at < by_anchor.size:
            end, words = at, 0
            while end < by_anchor.size and (words < SHARD_WORDS or own[one[by_anchor[end]]] == own[one[by_anchor[end - 1]]]):
                words += int(size[one[by_anchor[end]]])
                end += 1
            part = by_anchor[at:end]
            part = part[np.argsort(docs[one[part]], kind="stable")]
            automaton = SuffixAutomaton()
            texts = [h[begin[p] : begin[p] + size[p]].tolist() for p in one[part]]
            for p, text in zip(one[part], texts, strict=True):
                automaton.add(text, int(docs[p]))
            for k, text in zip(part, texts, strict=True):
                found[k] = automaton.matches(text, window)[window - 1 :]
            at = end
        lens = np.array([len(x) for x in found], np.int64)
        flat, where = np.array([d for x in found for d in x], np.int64), np.append(0, np.cumsum(lens))
        out = []
        for g in range(shard.num_rows):
            mine = slice(*np.searchsorted(group, [g, g + 1]))
            c = code[mine]
            c_lens = lens[c]
            cells = np.repeat(where[c], c_lens) + (np.arange(int(c_lens.sum())) - np.repeat(np.cumsum(c_lens) - c_lens, c_lens))
            earlier = flat[cells] < np.repeat(docs[mine], c_lens)
            out.append((keys[mine].tobytes(), c_lens.astype(np.uint32).tobytes(), earlier.astype(np.uint8).tobytes()))
        return pa.table({"grp": shard.column("grp"), **{name: pa.array([x[k] for x in out], pa.binary()) for k, name in enumerate(("keys", "lens", "earlier"))}})

    return run


def _finish(window: int, shards: int):
    def run(key: tuple, group: pa.Table, replies: pa.Table) -> pa.Table:
        group = _sorted_group(group)
        ids = group.column("id").to_numpy()
        keys, lens, before = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_buffer(), t) for x in replies.column(name) if x.is_valid and x.as_buffer().size)]) for name, t in (("keys", _U), ("lens", np.uint32), ("earlier", np.uint8)))
        order, lens = np.argsort(keys, kind="stable"), lens.astype(np.int64)
        smallest = np.full(keys.size, np.iinfo(np.int64).max)  # of the group's documents with each passage; ids ascend
        keys, where, lens = keys[order], (np.cumsum(lens) - lens)[order], lens[order]
        n_words, n_removed, kept = [], [], []
        texts = group.column("text")
        for row, h, at, rows, first, size, _ in _candidates(texts, replies, window, shards):
            covered = np.zeros(h.size + 1, np.int64)
            if rows.size:
                place = np.searchsorted(keys, _sequence_keys(h, first, size + window - 1))
                within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                np.minimum.at(smallest, place, ids[rows + row])
                earlier = (before[np.repeat(where[place], size) + within] > 0) | np.repeat(ids[rows + row] > smallest[place], size)
                hit = (np.repeat(first, size) + within)[earlier]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + window, -1)
            gone = np.cumsum(covered)[:-1] > 0
            for i in range(at.size - 1):
                out = gone[at[i] : at[i + 1]]
                removed = int(out.sum())
                text = texts[row + i].as_py() or ""
                words = text.encode().split()
                n_words.append(len(words))
                n_removed.append(removed)
                kept.append(b" ".join(words) if not removed else b" ".join(w for w, x in zip(words, out.tolist(), strict=True) if not x))
        return pa.table({"id": group.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(id_col, n_words, n_removed, text): texts without the words that smaller documents have in windows of words.

    Words are runs of bytes other than ASCII white space, unchanged; the text's
    kept words are joined by one space. A word goes if a window over it, all within
    its document, also starts in a document with a smaller id; windows are judged
    on the input.

    Documents are dealt into groups of about GROUP_BYTES by a hash. From each group
    a shard gets each anchor once, and each sequence of words around a shared
    anchor once, however often the group holds it; the answers go back to the
    groups. The windows around an anchor of more than hot_runs runs are dealt out
    each by its own hash. window is more than ANCHOR_WORDS. Words are compared by 40
    bits of their hashes, the one inexactness.

    Null and empty texts have no words. Rows with a null id have no place in the
    order: they lose nothing and nothing is lost to them. Rows that repeat an id
    count as one document, each with its own row. Other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, int(size) // GROUP_BYTES)
    shards = max(8 * parallelism(spark), groups)
    named = own.filter("id is not null").withColumn("grp", F.pmod(F.xxhash64("id", F.lit(53)), F.lit(groups)))
    dealt = named.select("grp", "id", F.coalesce("text", F.lit("")).alias("text")).repartition(max(parallelism(spark), groups), "grp")
    packed = "shard int, grp long, " + ", ".join(f"c{k} binary" for k in range(5))
    anchors = dealt.groupBy("grp").applyInArrow(_anchors(window, shards, hot_runs), "shard int, grp long, c0 binary, c1 binary")
    shared = anchors.groupBy("shard").applyInArrow(_shared(hot_runs), "grp long, shard int, anchors binary, hot binary")
    passages = dealt.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(_passages(window, shards), packed)
    matched = passages.groupBy("shard").applyInArrow(_match(window), "grp long, keys binary, lens binary, earlier binary")
    replies = matched.unionByName(shared, allowMissingColumns=True)
    done = dealt.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(_finish(window, shards), "id long, n_words long, n_removed long, text string")
    nameless = own.filter("id is null").select("id", F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\f\r", "     "), " "), lambda w: w != "").alias("words"))
    nameless = nameless.select("id", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("words", " ").alias("text"))
    return done.unionByName(nameless).withColumnRenamed("id", id_col)

"""Pairs of near-copy editions among texts, found by MinHash and confirmed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators.components import components
from variorum.runtime import cut, dealt

_U = np.uint64
#: fixed values: a pair at 0.5 shares none of the bands with a chance of (1 - 0.5**ROWS)**BANDS, 4e-8
BANDS, ROWS = 128, 3
#: sets a side of a block; so many bytes of a block's sets as bits; so many classes that a task remembers; so many marks, by a power of two
BLOCK, BITS, SEEN, MARKS = 256, 1 << 26, 1 << 20, 26
#: sets a side of a block without listed pairs, and their bytes; so many meetings are listed at once, and of more a pair all pairs are compared
SIDE, SIDE_BYTES, LISTED, TIMES = 2048, 1 << 24, 1 << 22, 16
#: leading bits of a band: those of its range, those that are compared, those that have a mark (32 MB)
RANGE, KEY, SLOT = 10, 34, 28


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _shingles(column: pa.ListArray, k: int) -> Iterator[np.ndarray]:
    """Per row of word hashes the sorted distinct hashes of its runs of k words."""
    offs, words = column.offsets.to_numpy(), column.values.to_numpy().view(_U)
    for i, j in zip(offs[:-1], offs[1:], strict=True):
        m = max(0, j - i - k + 1)
        out = np.full(m, k, _U)
        for n in range(k):
            out = _mix(out ^ words[i + n : i + n + m]) if m else out
        yield np.unique(out)


def _class(s: np.ndarray) -> int:
    """One number for equal sets."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bands(s: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS MinHash values; shingle hashes are mixed already, so odd factors reorder them."""
    factors = _mix(np.arange(1, BANDS * ROWS + 1, dtype=_U)) | _U(1)
    step = max(1, (1 << 15) // s.size)
    least = np.concatenate([(s[None, :] * factors[i : i + step, None]).min(1) for i in range(0, factors.size, step)]).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=_U)
    for n in range(ROWS):
        out = _mix(out ^ least[:, n])
    return out


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, sizes, bands = [], [], []
            for s in _shingles(batch.column(1), k):
                names.append(_class(s))
                sizes.append(s.size)
                # a class that a task has met has its bands there
                bands.append(_bands(s).view(np.int64) if s.size and names[-1] not in seen else np.zeros(0, np.int64))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(names[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "cls", "n", "bands"])

    return run


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(1 << MARKS, bool)
    for batch in batches:
        marks[batch.column(0).to_numpy()] = True
    at = np.packbits(marks)
    page = 1 << 12
    for i in np.flatnonzero(at.reshape(-1, page).any(1)):
        yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int64()), pa.array([at[i * page : (i + 1) * page].tobytes()], pa.binary())], names=["i", "marks"])


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with a mark of their id among those of ids: some more than those wanted, so that a join decides, but few others travel to it."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARKS))
    page = 1 << 12

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                kept[i] = kept[i] | x if i in kept else x
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array([x.tobytes() for x in kept.values()], pa.binary())], names=["i", "marks"])

    pages = ids.select(place).distinct().coalesce(64).mapInArrow(_marker, "i long, marks binary").repartition("i").mapInArrow(either, "i long, marks binary")
    marks = np.zeros((1 << MARKS) // 8, np.uint8)
    for r in pages.collect():  # 8 MB at most
        marks[r.i * page : (r.i + 1) * page] |= np.frombuffer(r.marks, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(marks.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = batch.column("__at").to_numpy()
            yield batch.filter(pa.array((own[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))).drop_columns(["__at"])

    return docs.withColumn("__at", place).mapInArrow(run, docs.schema)


def _setter(k: int, texts: bool):
    """(doc_id, cls) of (doc_id, text, word hashes) with the text or the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_shingles(batch.column(2), k))
            more = batch.column(1) if texts else pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_class(s) for s in sets], pa.int64()), more], names=["doc_id", "cls", "text" if texts else "s"])

    return run


def _shared(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of pairs of sets, by numbers; sets of a block are compared as bits where these are few."""
    values, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    bits = int(common.sum())
    if len(pairs) > 8 and len(sets) * bits // 8 <= BITS:
        at = np.cumsum(common) - 1
        table = np.zeros((len(sets), max(1, bits // 64 + 1) * 8), np.uint8)
        end = 0
        for row, s in zip(table, sets, strict=True):
            own = places[end : end + s.size]
            flags = np.zeros(table.shape[1] * 8, bool)
            flags[at[own[common[own]]]] = True
            row[:] = np.packbits(flags)
            end += s.size
        words = table.view(_U)
        step = max(1, (1 << 21) // words.shape[1])
        return np.concatenate([np.bitwise_count(words[p[:, 0]] & words[p[:, 1]]).sum(1, dtype=np.int64) for p in (pairs[i : i + step] for i in range(0, len(pairs), step))])
    return np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in pairs], np.int64)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, jaccard) of rows (k, u, v, s): of each block k its sets, with v null, and then its pairs."""

    def told(sets: dict[int, np.ndarray], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        place = {u: i for i, u in enumerate(sets)}
        both = _shared(list(sets.values()), np.array([(place[u], place[v]) for u, v in pairs], np.int64))
        sizes = [sets[u].size + sets[v].size for u, v in pairs]
        found = [n / (m - n) for n, m in zip(both.tolist(), sizes, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64()), pa.array(found, pa.float64())], names=["u", "v", "jaccard"])

    block, sets, pairs = None, {}, []
    for batch in batches:
        for k, u, v, s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != block:
                if pairs:
                    yield told(sets, pairs)
                block, sets, pairs = k, {}, []
            if v is None:
                sets[u] = np.frombuffer(s, _U)
            else:
                pairs.append((u, v))
    if pairs:
        yield told(sets, pairs)


def _confirmed(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, jaccard) of candidates (u, v), u < v, with the sets (cls, s).

    Classes are dealt out by the least class that they meet, in blocks of BLOCK. A set
    travels once to each pair of blocks that has candidates with it, not to each candidate.
    """
    lead = met.select(F.col("u").alias("c"), F.col("u").alias("lead")).unionByName(met.select(F.col("v").alias("c"), F.col("u").alias("lead"))).groupBy("c").agg(F.min("lead").alias("lead"))
    lead = cut(lead)
    many = lead.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = lead.join(many, "lead").select("c", F.xxhash64("lead", F.pmod(F.xxhash64("c"), F.col("blocks"))).alias("b"))
    dealt_pairs = met.join(placed.toDF("u", "x"), "u").join(placed.toDF("v", "y"), "v")
    dealt_pairs = cut(dealt_pairs.select(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("k"), "u", "v"))
    needed = dealt_pairs.select("k", F.col("u").alias("cls")).unionByName(dealt_pairs.select("k", F.col("v").alias("cls"))).distinct().join(sets, "cls")
    rows = needed.select("k", F.col("cls").alias("u"), F.lit(None).cast("long").alias("v"), "s").unionByName(dealt_pairs.select("k", "u", "v", F.lit(None).cast("binary").alias("s")))
    return dealt(rows, "k").sortWithinPartitions("k", F.col("v").asc_nulls_first()).mapInArrow(_alike, "u long, v long, jaccard double")


def _candidates(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Pairs of numbers of sets, all those above least among them.

    Each set is put in order by how many sets hold a value, the rarest first. Two sets
    above least have more than that share of either one, so that they meet within what
    is left of both when as many of their last values are taken off.
    """
    count = len(sets)
    if count == 2:
        return np.array([[0, 1]], np.int64)
    n = np.array([s.size for s in sets], np.int64)
    owner = np.repeat(np.arange(count), n)
    _, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_count = np.argsort(counts, kind="stable")
    rank = np.empty(counts.size, np.int64)
    rank[by_count] = np.arange(counts.size)
    own = rank[places]
    own = own[np.lexsort((own, owner))]
    within = np.arange(own.size) - np.repeat(np.cumsum(n) - n, n)
    kept = (within < np.repeat(n - np.floor(least * n * (1 - 1e-12)).astype(np.int64), n)) & (counts[by_count[own]] > 1)
    own, owner = own[kept], owner[kept]
    order = np.argsort(own, kind="stable")
    own, owner = own[order], owner[order]
    start = np.searchsorted(own, own)
    before = np.arange(own.size) - start
    ends = np.cumsum(before)
    if own.size and ends[-1] > TIMES * count * count:
        return np.stack(np.triu_indices(count, 1), 1)
    met = np.zeros((count, count), bool)
    i = 0
    while i < own.size:
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + LISTED, "right")))
        each = before[i:j]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[i:j], each)
        met[owner[at], np.repeat(owner[i:j], each)] = True
        i = j
    return np.argwhere(met)


def _linker(least: float, nearest: bool):
    """(a_id, b_id, jaccard, a, b) of rows (k, side, cls, doc_id, s): alike classes of each block k, a_id < b_id.

    Of sides 0 and 1 each set meets those of the other one, of side 2 all. With
    nearest there is of each b its likest a, of ties the smallest.
    """

    def told(rows: dict[int, tuple]) -> Iterator[tuple]:
        cls = np.array(list(rows), np.int64)
        side, ids, sets = (list(x) for x in zip(*rows.values(), strict=True))
        side, n = np.array(side), np.array([s.size for s in sets], np.int64)
        if len(sets) < 2 or (side[0] != 2 and (side == side[0]).all()):
            return
        p = _candidates(sets, least)
        x, y = p[:, 0], p[:, 1]
        p = p[((side[x] == 2) | (side[x] != side[y])) & (np.minimum(n[x], n[y]) > least * np.maximum(n[x], n[y]))]
        if not len(p):
            return
        both = _shared(sets, p)
        jaccard = both / (n[p[:, 0]] + n[p[:, 1]] - both)
        kept = (jaccard > least) & (jaccard < 1)
        p, jaccard = p[kept], jaccard[kept]
        places = {d: i for i, d in enumerate(sorted(set(ids)))}
        at = np.array([places[d] for d in ids], np.int64)
        turned = at[p[:, 0]] > at[p[:, 1]]
        a, b = np.where(turned, p[:, 1], p[:, 0]), np.where(turned, p[:, 0], p[:, 1])
        order = np.lexsort((cls[a], at[a], -jaccard, b))
        order = order[at[a[order]] != at[b[order]]]
        if nearest:
            order = order[np.unique(b[order], return_index=True)[1]]
        for i in order:
            yield ids[a[i]], ids[b[i]], float(jaccard[i]), int(cls[a[i]]), int(cls[b[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, out, kind = None, {}, [], None

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            types = [kind, kind, pa.float64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["a_id", "b_id", "jaccard", "a", "b"])

        for batch in batches:
            kind = batch.column(3).type
            for k, side, cls, doc, s in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if k != block:
                    if len(rows) > 1:
                        out.extend(told(rows))
                    if len(out) > 1 << 14:
                        yield ready()
                    block, rows = k, {}
                rows[cls] = (side, doc, np.frombuffer(s, _U))
        if len(rows) > 1:
            out.extend(told(rows))
        if out:
            yield ready()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, x) of lists of bands: for each range p the sorted keys by their differences, after a byte with the width of these."""

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(parts) >> _U(64 - KEY))
        ends = np.searchsorted(keys, np.arange(1, (1 << RANGE) + 1, dtype=_U) << _U(KEY - RANGE))
        names, found, i = [], [], 0
        for p, j in enumerate(ends.tolist()):
            if j > i:
                steps = np.diff(keys[i:j], prepend=_U(p << (KEY - RANGE))).astype("<u4")
                width = max(1, (int(steps.max()).bit_length() + 7) // 8)
                names.append(p)
                found.append(bytes([width]) + steps.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
            i = j
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(found, pa.binary())], names=["p", "x"])

    parts, size = [], 0
    for batch in batches:
        parts.append(batch.column(0).flatten().to_numpy().view(_U))
        size += parts[-1].size
        if size >= LISTED:
            yield packed(parts)
            parts, size = [], 0
    if size:
        yield packed(parts)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, marks) of the ranges p: a bit for each slot that has a key which occurs twice."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            steps = np.zeros(((len(x) - 1) // x[0], 4), np.uint8)
            steps[:, : x[0]] = np.frombuffer(x, np.uint8, offset=1).reshape(-1, x[0])
            parts.setdefault(p, []).append(np.cumsum(steps.view("<u4")[:, 0], dtype=np.uint32))
    for p, own in parts.items():
        keys = np.sort(np.concatenate(own))
        marks = np.zeros(1 << (SLOT - RANGE), bool)
        marks[keys[1:][keys[1:] == keys[:-1]] >> (KEY - SLOT)] = True
        if marks.any():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["p", "marks"])


def _entries(sketched: DataFrame) -> DataFrame:
    """(cls, n, band) of bands that several rows have, and few others.

    Most bands are of one class alone. To tell them, a few bits of each travel first,
    two or three bytes a band; what has equal bits is marked.
    """
    pages = dealt(sketched.select("bands").mapInArrow(_keys, "p int, x binary"), "p").mapInArrow(_repeated, "p int, marks binary")
    size = 1 << (SLOT - RANGE - 3)
    marks = bytearray(size << RANGE)
    for r in pages.collect():  # 32 MB at most
        marks[r.p * size : (r.p + 1) * size] = r.marks
    sent = sketched.sparkSession.sparkContext.broadcast(bytes(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            lists = batch.column(2)
            bands = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = (bands.view(_U) >> _U(64 - SLOT)).astype(np.int64)
            kept = (own[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            row = row[kept]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row], pa.int64()), pa.array(batch.column(1).to_numpy()[row], pa.int64()), pa.array(bands[kept], pa.int64())], names=["cls", "n", "band"])

    return sketched.select("cls", "n", "bands").mapInArrow(run, "cls long, n long, band long")


def _shared_bands(sketched: DataFrame, least: float) -> DataFrame:
    """(band, cls, n, low) of classes that share a band with one near enough in size.

    Classes of a band are put in order by size; low is the first of a run of classes
    each of which is near enough to the one before it.
    """
    by_band = Window.partitionBy("band")
    by_size = by_band.orderBy("n", "cls")
    several = _entries(sketched).withColumn("several", F.min("cls").over(by_band) < F.max("cls").over(by_band)).filter("several")
    # alike above `least` means that the smaller set has more than that share of the larger
    last, following = F.coalesce(F.lag("n").over(by_size) > least * F.col("n"), F.lit(False)), F.coalesce(F.col("n") > least * F.lead("n").over(by_size), F.lit(False))
    runs = several.select("cls", "n", "band").dropDuplicates(["band", "cls"]).withColumns({"last": last, "following": following})
    runs = runs.withColumn("low", F.last(F.when(~F.col("last"), F.col("cls")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter("last or following").select("band", "cls", "n", "low")


def _placed(shared: DataFrame, one: DataFrame) -> DataFrame:
    """(cls, first, part, at, meets) of classes of one: the component by shared bands, the block in it, the blocks of it that the class meets.

    A block has about SIDE sets or SIDE_BYTES. The blocks that a class meets are those
    of the classes in its bands, marked by bits: from 64 blocks on, those with an equal
    remainder are met together.
    """
    edges = shared.filter("cls <> low").select(F.col("cls").alias("u"), F.col("low").alias("v")).distinct()
    placed = one.join(components(edges).toDF("cls", "part"), "cls")
    many = placed.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum("n") * 8 / SIDE_BYTES)).alias("blocks"))
    placed = cut(placed.join(many, "part").select("cls", F.col("doc_id").alias("first"), "part", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("at")))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    rows = shared.select("band", "cls", "low").join(placed.filter("blocks > 1").select("cls", bit.alias("bit")), "cls")
    bits = rows.withColumn("bits", F.bit_or("bit").over(Window.partitionBy("band", "low"))).groupBy("cls").agg(F.bit_or("bits").alias("bits"))
    meets = F.expr("filter(sequence(0L, blocks - 1), y -> bits is null or shiftright(bits, cast(y % 64 as int)) & 1L = 1L)")
    return placed.join(bits, "cls", "left").select("cls", "first", "part", "at", meets.alias("meets"))


def _met_classes(docs: DataFrame, shingle_words: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, cls) of all texts with shingles; shared bands; (cls, doc_id, n) of the classes in them; (doc_id, cls, s) of their texts.

    Texts of equal shingle sets are one class, which is sketched once a task. Classes
    that share a band of MinHash values are candidates, and all of these are confirmed
    on the full sets of 64-bit hashes; a pair above 0.5 is missed with a chance of
    4e-8 at most.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.filter("doc_id is not null")
    sketched = cut(_hashed(docs).drop("text").mapInArrow(_sketcher(shingle_words), f"doc_id {kind}, cls long, n long, bands array<long>").filter("n > 0"))
    shared = cut(_shared_bands(sketched, least))
    classes = shared.select("cls").distinct()
    one = cut(sketched.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")))
    sets = _hashed(_marked(docs.select("doc_id", "text"), one)).mapInArrow(_setter(shingle_words, False), f"doc_id {kind}, cls long, s binary")
    return sketched.select("doc_id", "cls"), shared, one, sets


def _alike_classes(docs: DataFrame, shingle_words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls) of all texts with shingles, (u, v, jaccard) of alike classes, from a list of candidates."""
    sketched, shared, one, sets = _met_classes(docs, shingle_words, least)
    u, v = shared.select(F.col("cls").alias("u"), F.col("n").alias("u_n"), "band"), shared.select(F.col("cls").alias("v"), F.col("n").alias("v_n"), "band")
    sizes = F.least("u_n", "v_n") > least * F.greatest("u_n", "v_n")
    met = cut(u.join(v, "band").filter((F.col("u") < F.col("v")) & sizes).select("u", "v").distinct())
    sets = sets.join(one.select("cls", F.col("doc_id").alias("first")), "cls").filter(F.col("doc_id") == F.col("first")).select("cls", "s").dropDuplicates(["cls"])
    return sketched, cut(_confirmed(met, sets).filter((F.col("jaccard") > least) & (F.col("jaccard") < 1)))


def _linked(docs: DataFrame, shingle_words: int, least: float, nearest: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls) of all texts with shingles, (a_id, b_id, jaccard, a, b) of alike classes by their smallest ids, a_id < b_id.

    With nearest there is the likest a of each b and block. Candidates are not listed:
    their number grows with the square of a group of texts that share a line. A set
    travels once to each pair of blocks in which it may have some.
    """
    kind = dict(docs.dtypes)["doc_id"]
    sketched, shared, one, sets = _met_classes(docs, shingle_words, least)
    rows = sets.join(_placed(shared, one), "cls").filter(F.col("doc_id") == F.col("first")).select("cls", "doc_id", "s", "part", "at", F.explode("meets").alias("y"))
    side = F.when(F.col("at") == F.col("y"), 2).when(F.col("at") < F.col("y"), 0).otherwise(1)
    rows = rows.select(F.xxhash64("part", F.least("at", "y"), F.greatest("at", "y")).alias("k"), side.alias("side"), "cls", "doc_id", "s")
    return sketched, cut(dealt(rows, "k").sortWithinPartitions("k").mapInArrow(_linker(least, nearest), f"a_id {kind}, b_id {kind}, jaccard double, a long, b long"))


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, w): the hashes of the texts' words."""
    return docs.select("doc_id", "text", F.coalesce(F.transform(T.tokens(F.col("text")), lambda w: F.xxhash64(w)), F.array().cast("array<long>")).alias("w"))


def _texts(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, text, cls) of texts with (doc_id, cls) in wanted, dealt out by cls."""
    kind = dict(docs.dtypes)["doc_id"]
    own = _hashed(_marked(docs.select("doc_id", "text"), wanted)).mapInArrow(_setter(shingle_words, True), f"doc_id {kind}, cls long, text string")
    own, known = dealt(own, "cls"), dealt(wanted.select(F.col("cls").alias("k"), F.col("doc_id").alias("d")), "k")
    return own.join(known, (own["cls"] == known["k"]) & (own["doc_id"] == known["d"]), "left_semi").select("doc_id", "text", "cls")


def near_pairs(docs: DataFrame, shingle_words: int = 5, least: float = 0.5) -> DataFrame:
    """(a_id, b_id, jaccard, a_text, b_text), a_id < b_id: all pairs with least < jaccard < 1.

    A pair of classes gives the pairs of all their texts, so the rows grow with the
    square of a group of near copies; linked_classes and nearest_pairs don't. Texts
    shorter than a shingle and null texts are in no pair, nor is a row paired with
    one of its own id.
    """
    sketched, alike = _alike_classes(docs, shingle_words, least)
    classes = alike.select(F.col("u").alias("cls")).unionByName(alike.select(F.col("v").alias("cls"))).distinct()
    own = cut(_texts(docs, cut(sketched.join(classes, "cls", "left_semi")), shingle_words))
    texts = own.select("cls", F.struct("doc_id", "text").alias("x"))
    out = alike.join(texts.toDF("u", "x"), "u").join(texts.toDF("v", "y"), "v").filter("x.doc_id <> y.doc_id")
    out = out.select("jaccard", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return out.select(F.col("a.doc_id").alias("a_id"), F.col("b.doc_id").alias("b_id"), "jaccard", F.col("a.text").alias("a_text"), F.col("b.text").alias("b_text"))


def linked_classes(docs: DataFrame, shingle_words: int = 5, least: float = 0.5) -> DataFrame:
    """(a_id, b_id, jaccard): links between classes, named by their smallest ids, and members with 1.0.

    A class is the texts of one shingle set; its members are pairs of its smallest id
    and each other one. Two classes above `least` are a pair of their smallest ids.
    Texts shorter than a shingle and null texts are in no class; null ids stay out.
    """
    sketched, found = _linked(docs.filter("doc_id is not null"), shingle_words, least, False)
    first = sketched.groupBy("cls").agg(F.min("doc_id").alias("first"))
    members = sketched.distinct().join(first, "cls").filter("doc_id <> first").select(F.col("first").alias("a_id"), F.col("doc_id").alias("b_id"), F.lit(1.0).alias("jaccard"))
    return found.select("a_id", "b_id", "jaccard").unionByName(members)


def nearest_pairs(docs: DataFrame, shingle_words: int = 5, least: float = 0.5) -> DataFrame:
    """(a_id, b_id, jaccard, a_text, b_text): each text with the likest one of smaller id, of ties the smallest.

    Of a class the text of the smallest id stands for all. A group of n near copies
    gives n - 1 pairs at most, so that it can be collated whatever its size. Pairs are
    dealt out by b_id. Other rules are those of linked_classes.
    """
    docs = docs.filter("doc_id is not null")
    kind = dict(docs.dtypes)["doc_id"]
    _, found = _linked(docs, shingle_words, least, True)
    best = cut(found.groupBy("b_id").agg(F.min(F.struct(-F.col("jaccard"), "a_id", "a", "b")).alias("m")).select("m.a_id", "b_id", (-F.col("m.col1")).alias("jaccard"), "m.a", "m.b"))
    pair = F.struct("a_id", "b_id", "jaccard")
    wanted = best.select(F.col("a_id").alias("d"), F.col("a").alias("cls"), F.lit(True).alias("smaller"), pair.alias("pair")).unionByName(best.select(F.col("b_id").alias("d"), F.col("b").alias("cls"), F.lit(False).alias("smaller"), pair.alias("pair")))
    texts = _hashed(_marked(docs.select("doc_id", "text"), wanted.select(F.col("d").alias("doc_id")))).mapInArrow(_setter(shingle_words, True), f"doc_id {kind}, cls long, text string")
    sides = texts.join(wanted, "cls").filter(F.col("doc_id") == F.col("d")).select("pair.*", "smaller", "text")
    # rows of one id and class may differ in white space
    a, b = F.min(F.when(F.col("smaller"), F.col("text"))), F.min(F.when(~F.col("smaller"), F.col("text")))
    return dealt(sides, "b_id").groupBy("b_id").agg(F.min("a_id").alias("a_id"), F.min("jaccard").alias("jaccard"), a.alias("a_text"), b.alias("b_text")).select("a_id", "b_id", "jaccard", "a_text", "b_text")

"""MinHash near-duplicates: fast similarity sketches, banding, exact verification.

A sketch has one value per bin. Each round throws every shingle into a hashed bin;
a bin keeps its smallest value, with the round in front. After `bins` rounds, round
bins + b fills bin b whatever the shingles are, so that every coordinate is filled;
rounds after the one that fills the last bin change nothing and aren't run
(Dahlgaard, Knudsen, Thorup: Fast Similarity Sketching, 2017).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.components import components
from variorum.llm.words import mix, seeds, shingle_sets
from variorum.runtime import cut

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_LOW = _U(0xFFFFFFFF)
BLOCK_MEMBERS = 256
#: a class of more than one in so many rows is a hot one
HOT_CLASSES = 1000
#: as many bits, by a power of two, mark the ids whose sets are looked for
MARK_BITS = 26


def fast_sketch(x: np.ndarray, bins: int, salts: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes; salts has 2 * bins values."""
    out = np.full(bins, _EMPTY, _U)
    step = math.ceil(bins * (math.log(bins) + 3) / x.size)
    done = 0
    while done < bins:
        r = min(step, bins - done, max(1, (1 << 20) // x.size))
        h = mix(x[None, :] ^ salts[done : done + r, None])
        at = (((h >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64).ravel()
        rounds = (np.arange(done, done + r, dtype=_U) << _U(32))[:, None]
        np.minimum.at(out, at, ((h & _LOW) | rounds).ravel())
        done += r
        if not (out == _EMPTY).any():
            return out
        step = max(1, step // 2)
    for b in np.flatnonzero(out == _EMPTY):
        out[b] = (_U(bins + int(b)) << _U(32)) | (mix(x ^ salts[bins + b]) & _LOW).min()
    return out


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One hash per band of equal numbers of coordinates; bands differ in their hashes."""
    cells = sketch.reshape(bands, -1)
    acc = seeds(bands, 23)
    for i in range(cells.shape[1]):
        acc = mix(acc ^ (cells[:, i] * _U(0x9E3779B97F4A7C15)))
    return acc


def _sketcher(shingle_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = seeds(2 * bands * rows, 11)
        keys = seeds(2, 13)
        for batch in batches:
            sizes, key_a, key_b, lists = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column(1), shingle_words):
                    sizes.append(s.size)
                    key_a.append(mix(s ^ keys[0]).sum(dtype=_U))
                    key_b.append(mix(s ^ keys[1]).sum(dtype=_U))
                    lists.append(band_hashes(fast_sketch(s, bands * rows, salts), bands) if s.size else np.zeros(0, _U))
            offs = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([x.size for x in lists], out=offs[1:])
            flat = np.concatenate(lists) if lists else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(key_a, _U).view(np.int64)), pa.array(np.array(key_b, _U).view(np.int64)), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))],
                names=["id", "n_shingles", "key_a", "key_b", "bands"],
            )

    return run


def _marks(ids: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits in bytes, set where a hash of an id points; that many bits come to the driver, however many ids there are."""
    at = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("at")).select((F.col("at") + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("marks"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():
        own = np.frombuffer(r.marks, np.uint8)
        out[(r.part - 1) * own.size :][: own.size] = own
    return out


def _setter(shingle_words: int, marks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(marks[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), shingle_words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _verifier(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
                both = np.intersect1d(a, b, assume_unique=True).size
                keep.append(both > 0 and den * both >= num * (a.size + b.size - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(query: list[np.ndarray], member: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """The sizes of all intersections, by products of membership matrices a slice of shingles at a time."""
    sizes = [x.size for x in (*query, *member)]
    names, code = np.unique(np.concatenate([*query, *member]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(code, minlength=names.size)[code] > 1
    row, code = row[often], code[often]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(query), len(member)), np.float32)
    for low in range(0, names.size, columns):
        i, j = np.searchsorted(code, [low, low + columns])
        if i < j:
            cells = np.zeros((len(sizes), columns), np.float32)
            cells[row[i:j], code[i:j] - low] = 1
            out += cells[: len(query)] @ cells[len(query) :].T
    return out


def _block_links(rows: list[tuple[int, int, bool, np.ndarray]], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links between different components of a block's queries and members, enough to join them."""
    query, member = [x for x in rows if x[2]], [x for x in rows if not x[2]]
    if not query or not member:
        return
    n_q, n_m = (np.array([x[3].size for x in part], float) for part in (query, member))
    both = _common([x[3] for x in query], [x[3] for x in member])
    near = (den * both >= num * (n_q[:, None] + n_m[None, :] - both)) & (both > 0)
    near &= np.array([x[1] for x in query])[:, None] != np.array([x[1] for x in member])[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(query[i][1]), root(member[j][1])
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield query[i][0], member[j][0]


def _block_linker(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush() -> pa.RecordBatch:
            found = list(_block_links(rows, num, den))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for at, rep, own, asks, shingles in zip(keys, *(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
                if at != key:
                    yield flush()
                    key = at
                rows.append((rep, own, asks, np.frombuffer(shingles, _U)))
        yield flush()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: tuple[int, int] = (4, 5), bands: int = 64, rows: int = 7) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): documents linked by a Jaccard similarity of num/den or more.

    Words are lower-cased in A-Z. Equal shingle sets are one class from the start,
    so copies, however many, cost one sketch entry. A class meets the smallest
    member of each bucket it is in, its leader; members of a leader's buckets that
    are not in its component then meet all its other members, in blocks that give
    back only what joins components. Each link is confirmed on the full sets. A pair
    at the threshold has a chance of about (1 - 0.8**rows)**bands, 3e-7, to share no
    bucket.

    Classes of more than one in HOT_CLASSES rows, of which there are no more than
    that, are broadcast to their rows, so that no task gets all copies of a text. A
    block holds about BLOCK_MEMBERS sets that ask and as many that are asked. A
    family of m members of which a are outside its leader's component has
    a * m / BLOCK_MEMBERS**2 blocks, and sends (a + m) sets that often a side; m counts
    different texts that share a bucket of `rows` equal coordinates with one text.

    Null or empty texts have no shingles and no links. Rows with a null id keep
    a null component and are kept. Repeated rows give repeated rows; where one id
    stands on different texts, each row has the component of its own text. Other
    columns are not read.
    """
    num, den = similarity
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_shingles long, key_a long, key_b long, bands array<long>"
    sketched = cut(texts.mapInArrow(_sketcher(shingle_words, bands, rows), schema))
    known = sketched.filter("id is not null and n_shingles > 0")
    classes = known.groupBy("key_a", "key_b").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    reps = known.join(classes.select("key_a", "key_b", F.col("rep").alias("id")), ["id", "key_a", "key_b"], "left_semi")
    entries = reps.select(F.col("id").alias("rep"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader <> last").select("bucket", "leader")
    met = cut(entries.join(shared, "bucket").filter("rep <> leader").select("leader", "rep").distinct())
    nodes = met.select(F.col("rep").alias("id")).union(met.select("leader")).distinct()
    # the sets of nodes alone travel; a mark that stands for other ids too costs a set on its way to the join
    placed = texts.filter("id is not null").withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << MARK_BITS)))
    sets = placed.mapInArrow(_setter(shingle_words, _marks(nodes, MARK_BITS)), "id long, shingles binary")
    sets = cut(sets.join(nodes, "id", "left_semi"))
    both = met.join(sets.toDF("leader", "set_u"), "leader").join(sets.toDF("rep", "set_v"), "rep").select("leader", "rep", "set_u", "set_v")
    labels = cut(components(cut(both.mapInArrow(_verifier(num, den), "u long, v long"))))
    # the members of all buckets that a class leads are its family; where they lie in several
    # components, those outside the leader's meet the whole family, in blocks
    own, first = F.coalesce("component", "rep"), F.coalesce("component", "leader")
    family = met.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("leader", "rep", own.alias("own"))
    family = family.join(labels.withColumnRenamed("node", "leader"), "leader", "left").select("leader", "rep", "own", (F.col("own") != first).alias("out"))
    family = cut(family)
    mixed = family.groupBy("leader").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.sum(F.col("out").cast("long")).alias("outs"), F.count("*").alias("size")).filter("low <> high")
    mixed = cut(mixed.select("leader", F.ceil(F.col("outs") / BLOCK_MEMBERS).cast("int").alias("asking"), F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int").alias("asked")))
    rest = family.join(mixed, "leader").withColumns({"i": F.pmod(F.xxhash64("rep", F.lit(2)), F.col("asking")).cast("int"), "j": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("asked")).cast("int")})
    rest = rest.join(sets.toDF("rep", "shingles"), "rep")
    places = F.expr("transform(sequence(0, asking - 1), x -> struct(x as i, j as j, false as asks))")
    asking = F.expr("if(out, transform(sequence(0, asked - 1), x -> struct(i as i, x as j, true as asks)), array())")
    rest = rest.select("leader", "rep", "own", "shingles", F.explode(F.concat(places, asking)).alias("at")).select("leader", "at.i", "at.j", "rep", "own", "at.asks", "shingles")
    rest = rest.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    more = rest.mapInArrow(_block_linker(num, den), "u long, v long")
    labels = components(cut(labels.toDF("u", "v").unionByName(more)))
    named = classes.join(labels.toDF("rep", "component"), "rep", "left")
    named = cut(named.select("key_a", "key_b", "size", F.coalesce("component", "rep").alias("component_id")))
    hot = F.broadcast(named.filter(F.col("size") > sketched.count() / HOT_CLASSES).drop("size"))
    rows_of = sketched.drop("bands")
    cold = rows_of.join(hot, ["key_a", "key_b"], "left_anti").join(named.drop("size"), ["key_a", "key_b"], "left")
    out = cold.unionByName(rows_of.join(hot, ["key_a", "key_b"]))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

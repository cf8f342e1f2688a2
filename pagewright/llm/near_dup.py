"""MinHash near-duplicate documents: banded candidates, nearest first by odd sketch, links confirmed on full shingle sets.

Defined results: null, empty or all-white-space texts have an empty shingle set and link with nothing; equal sets form one
class and stay together; rows with a null id are never linked, have a null component and are kept; rows that share an id share its
component, whatever their texts: each of the texts keeps its own links, and the id joins them (a row without words keeps to its id alone);
extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, components, materialise, small
from pagewright.llm.hashing import common, mix, shingle_sets

BANDS, ROWS = 32, 5  # at a similarity of 0.8 a pair shares no band with a chance of 3e-6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SET_BITS = 1024  # parities of a second sketch, of the whole set
SLACK = 0.14  # of most_flips; 1.4e-4 of pairs at exactly 0.8 lie beyond it in a simulation (3.7 sigma), so no pair is dropped by it
NEAREST = 2  # closest partners of each member that the second round tries before the last one takes all pairs
CHUNK = 1024  # members of a bucket that one task compares with as many others

_rng = np.random.default_rng(20240229)
XORS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
ODDS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES minima for each non-empty set, one row per set."""
    ends = np.cumsum([0, *map(len, sets)])
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), SAMPLES), np.uint32)
    step = np.searchsorted(ends, np.arange(0, ends[-1] + 65536, 65536))
    for lo, hi in zip(step[:-1], step[1:]):
        if hi > lo:
            hi = min(hi, len(sets))
            part, at = h[ends[lo] : ends[hi]], ends[lo:hi] - ends[lo]
            for i in range(SAMPLES):
                out[lo:hi, i] = np.minimum.reduceat((part ^ XORS[i]) * ODDS[i], at)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of the key."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), 1))
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, j::ROWS])
    return key.view(np.int64)


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities: each sample flips the bit that its place and value hash to."""
    bit = mix(m.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    flat = bit.astype(np.int64) + np.arange(len(m))[:, None] * SKETCH_BITS
    odd = np.bincount(flat.ravel(), minlength=len(m) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(m), SKETCH_BITS), axis=1)


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SET_BITS parities of each whole set. Two of them never differ in more bits than the sets have members apart."""
    place = np.repeat(np.arange(len(sets)) * SET_BITS, [len(s) for s in sets])
    bit = (mix(np.concatenate(sets) + np.uint64(13)) % np.uint64(SET_BITS)).astype(np.int64)
    odd = np.bincount(place + bit, minlength=len(sets) * SET_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), SET_BITS), axis=1)


def most_flips(threshold: float) -> int:
    """The XOR population count beyond which a pair's estimated similarity is under threshold - SLACK."""
    n, k = SKETCH_BITS, SAMPLES
    return int(n / 2 * (1 - np.exp(-4 * k * (1 - max(0.0, threshold - SLACK)) / n)))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n_shingles, fp1, fp2, bands, sketch) of each row, streamed over Arrow batches; sketch holds both kinds of parities.

    fp1 and fp2 are a BLAKE2 digest of the whole sorted set: rows with one digest have one set.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 256):
                part = [(t or "").encode() for t in texts.slice(lo, 256).to_pylist()]
                sets = shingle_sets(part, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, sketch = [None] * len(sets), [None] * len(sets)
                if full:
                    m = minhashes([sets[i] for i in full])
                    for i, b, s, t in zip(full, band_keys(m), odd_sketches(m), set_sketches([sets[i] for i in full])):
                        bands[i], sketch[i] = b, s.tobytes() + t.tobytes()
                fp = digests([s.tobytes() for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, 256), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(
        run, "id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"
    )


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, set) of the given nodes (id, fp1, fp2, class_id): the shingle sets as sorted 64-bit hashes, one a node."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sets = [s.tobytes() for s in shingle_sets([(t or "").encode() for t in part.column(1).to_pylist()], words)]
                fp = digests(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(sets, pa.binary())], names=["doc", "fp1", "fp2", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    n = nodes.count()
    rows = rows.join(small(nodes.select(F.col("class_id").alias("doc")), n), "doc", "left_semi").mapInArrow(run, "doc long, fp1 long, fp2 long, set binary")
    # An id may stand for several texts; the digest says whose set this is.
    known = small(nodes.select("id", F.col("class_id").alias("doc"), "fp1", "fp2"), n)
    keys = ["doc", "fp1", "fp2"]
    return rows.join(known, keys).dropDuplicates(keys).select("id", "set")


def digests(sets: list[bytes]) -> np.ndarray:
    """Two longs for each set, of the BLAKE2 digest of its sorted hashes."""
    return np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                n = common(x, y)
                good.append(100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


CUT = SKETCH_BITS // 64  # words of the first kind


def close_pairs(x: tuple, y: tuple, percent: int, same: bool, nearest: int | None):
    """Index pairs from different components whose sizes and parities allow a link.

    x and y are (sketches, components, set sizes). nearest: only so many closest partners of each row of x by odd sketch; the
    sketch orders them and drops none for good.
    """
    (sx, cx, nx), (sy, cy, ny) = x, y
    for i in range(len(sx)):
        lo = i + 1 if same and nearest is None else 0
        fit = (cy[lo:] != cx[i]) & (100 * np.minimum(ny[lo:], nx[i]) >= percent * np.maximum(ny[lo:], nx[i]))
        at = np.flatnonzero(fit) + lo
        if len(at):
            flips = np.bitwise_count(sx[i] ^ sy[at])
            d = flips[:, :CUT].sum(axis=1, dtype=np.int64)
            # A link of these sizes has at most so many members apart; the whole sets' parities never overstate them.
            apart = flips[:, CUT:].sum(axis=1, dtype=np.int64)
            fit = (100 + percent) * apart <= (100 - percent) * (nx[i] + ny[at])
            at, d = at[fit], d[fit]
            for j in at if nearest is None else at[np.argsort(d, kind="stable")[:nearest]]:
                yield i, j


def open_pairs(members: DataFrame, sketches: DataFrame, comp: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """Candidate pairs of one bucket that lie in different components so far.

    A bucket is cut into chunks of about CHUNK members; each pair of chunks is one group, so no task holds a whole bucket.
    """
    m = members.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = mixed.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).select("key", "chunks")
    m = m.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    m = m.join(sketches, "id")
    with_all = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("i"), F.greatest(c, F.col("chunk")).alias("j")))
    m = m.withColumn("g", F.explode(with_all)).select("key", "g.i", "g.j", "chunk", "id", "component", "n_shingles", "sketch")

    def run(key, t):
        i, j = key[1].as_py(), key[2].as_py()
        chunk = t.column("chunk").to_numpy()
        ids, comps = t.column("id").to_numpy(), t.column("component").to_numpy()
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(t), -1)
        rows = (sk, comps, t.column("n_shingles").to_numpy())
        p, q = (np.flatnonzero(chunk == c) for c in (i, j))
        x, y = (tuple(v[r] for v in rows) for r in (p, q))
        found = [(p[u], q[v]) for u, v in close_pairs(x, y, percent, i == j, nearest)]
        if nearest is not None and i != j:
            found += [(q[u], p[v]) for u, v in close_pairs(y, x, percent, False, nearest)]
        left, right = ids[[u for u, _ in found]], ids[[v for _, v in found]]
        return pa.table({"a": pa.array(np.minimum(left, right), pa.int64()), "b": pa.array(np.maximum(left, right), pa.int64())})

    return m.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, n_shingles, class_id, component_id, kept) for each row of docs.

    Documents link if 100 * |A and B| >= 100 * threshold * |A or B| on their sets of distinct word shingles. Exact copies of a
    set are one class, so a group of copies of any size costs one row. Each bucket first links its members to its least and
    greatest member, then with its nearest ones by odd sketch; last, every pair of a bucket that is still in different components
    and whose set sizes and parities allow a link is taken. All are confirmed on the full sets, so no link of a bucket between
    different components is lost and none below the threshold is made. Different texts of one id are nodes of their own that the id joins.
    """
    percent = round(100 * threshold)
    sig = materialise(signatures(docs, id_col, text_col, words))
    filled = sig.where("n_shingles > 0 and id is not null")
    # Each class has a number of its own, as different texts may share an id.
    fp = ["fp1", "fp2", "n_shingles"]
    classes = materialise(filled.groupBy(*fp).agg(F.min("id").alias("class_id")).withColumn("node", F.monotonically_increasing_id()))
    # By the id too, so that a class of many copies isn't one key.
    reps = filled.join(classes.withColumnRenamed("class_id", "id"), [*fp, "id"]).dropDuplicates([*fp, "id"]).drop("id").withColumnRenamed("node", "id")
    keyed = reps.select("id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n > 1").select("key", "lo", "hi")
    members = materialise(keyed.join(buckets, "key").select("key", "id", "lo", "hi"))
    nodes = materialise(classes.withColumnRenamed("node", "id").join(members.select("id").distinct(), "id", "left_semi"))
    sets = materialise(full_sets(docs, nodes, id_col, text_col, words))
    sketches = reps.select("id", "n_shingles", "sketch").join(nodes.select("id"), "id", "left_semi")
    star = members.select(F.col("lo").alias("a"), F.col("id").alias("b")).unionAll(members.select(F.col("id").alias("a"), F.col("hi").alias("b")))
    links = materialise(confirmed(star.where("a <> b").distinct(), sets, percent))
    for nearest in (NEAREST, None):
        rest = materialise(open_pairs(members.select("key", "id"), sketches, components(links), percent, nearest))
        links = materialise(links.unionAll(confirmed(rest, sets, percent)))
    # The classes of one id belong together too.
    key = F.struct(*fp)
    several = materialise(filled.groupBy("id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("id", "lo"))
    of_id = filled.select("id", *fp).distinct().join(several, "id").join(classes.select(*fp, F.col("node").alias("a")), fp)
    of_id = of_id.join(classes.select(key.alias("lo"), F.col("node").alias("b")), "lo").select("a", "b").where("a <> b")
    comp = components(links.select("a", "b").unionAll(of_id)).join(classes.select("node", "class_id"), "node")
    least = materialise(comp.groupBy("component").agg(F.min("class_id").alias("component_id")))
    comp = comp.join(small(least, least.count()), "component").select("node", "component_id")
    known = classes.join(comp, "node", "left").select(*fp, "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = sig.select("id", *fp).join(known, fp, "left").withColumn("filled", (F.col("n_shingles") > 0) & F.col("id").isNotNull())
    out = out.withColumn("class_id", F.when(F.col("filled"), F.col("class_id")).otherwise(F.col("id")))
    out = out.withColumn("component_id", F.when(F.col("filled"), F.col("component_id")).otherwise(F.col("id")))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", "class_id", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )

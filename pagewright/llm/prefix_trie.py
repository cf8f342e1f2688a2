"""Prefix trie of conversations by Patricia construction over sorted turn sequences.

A conversation becomes one binary of 16-byte turn digests; equal sequences are counted once and sorted. Ranges of the order are scanned with
a stack: it holds only branch, end and leaf points joined by compressed edges, and sums members, leaves and saved words on them. Nodes inside an
edge are expanded last, from suffix sums of the words along it. A node that several ranges share lies on the path to a border between
two of them; each range gives its part of such nodes, and these parts are summed before the ranges are expanded. So no task holds more than a range.

Defined results: turns are ordered by turn, null first, then by the digest of role and text; null roles and texts are empty; rows without
a conversation id belong to none and are ignored; equal rows are turns of their own; an empty table gives no node; extra columns
are ignored. A conversation's turns travel as about 50 bytes each in one row, so it may have some tens of millions of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, materialise

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16
HEAD = 3  # longest head that is taken over from the first conversation of a block
BLOCK = 20
RANGE_TURNS = 200_000  # turns of a range of the order, about
PIECE = 1 << 16  # characters of joined ids that travel as one row
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE_SHA = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """32 hexadecimal digits that tell (role, text) apart."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv, turns): each conversation's turns in order, as (turn, digest, words); texts end here."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.struct(F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"),
    )
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, seq, words): the digests of each rebuilt conversation's turns and their word counts.

    The first h turns come from the first conversation of its block of ids, the others are its own after its first h.
    """
    own = materialise(conversations(turns).withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD + 1)).cast("int")).withColumn("first", F.col("conv") - F.col("conv") % BLOCK))
    heads = own.where("conv = first").select(F.col("conv").alias("first"), F.slice("turns", 1, HEAD).alias("head"))
    both = own.join(heads, "first", "left").withColumn("head", F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")))
    both = both.withColumn("t", F.concat("head", F.slice("turns", F.col("h") + 1, F.size("turns"))))
    seq = F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), ""))
    return both.select("conv", seq.alias("seq"), F.transform("t", lambda t: t["words"]).alias("words"))


def ends(rows: DataFrame) -> DataFrame:
    """(fp, n, low, sha) of the (fp, conv) rows of each fp: count, least conversation, digest of all their ids in ascending order.

    Ids are joined to pieces in ranges of the order of (fp, conv), whatever the size of an fp's group; its digest then reads its pieces one by one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        fp, part, ids, size = None, -1, [], 0
        out = []

        def close():
            if ids:
                out.append((fp, int(ids[0]), len(ids), ",".join(ids)))

        for batch in batches:
            for f, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if f != fp or size >= PIECE:
                    close()
                    fp, ids, size = f, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(out) > 64:
                yield from piece_rows(out)
                out.clear()
        close()
        yield from piece_rows(out)

    def piece_rows(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["fp", "low", "n", "ids"])

    def digest(batches):
        now, out = None, []
        for batch in batches:
            for fp, low, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now and now[0] == fp:
                    now[1] += n
                    now[3].update(b"," + ids.encode())
                else:
                    if now:
                        out.append((*now[:3], now[3].hexdigest()))
                    now = [fp, n, low, hashlib.sha256(ids.encode())]
            if out:
                yield end_rows(out)
                out.clear()
        if now:
            yield end_rows([(*now[:3], now[3].hexdigest())])

    def end_rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["fp", "n", "low", "sha"])

    joined = rows.repartitionByRange(parts, "fp", "conv").sortWithinPartitions("fp", "conv").mapInArrow(pieces, "fp binary, low long, n long, ids string")
    return bounded_batches(joined.repartition(parts, "fp").sortWithinPartitions("fp", "low")).mapInArrow(digest, "fp binary, n long, low long, sha string")


def common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences begin with alike."""
    if a is None or b is None:
        return 0
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    x, y = (np.frombuffer(v, np.uint64, 2 * n) for v in (a, b))
    return int(np.flatnonzero(x != y)[0]) // 2


def prefix_keys(seq: bytes, depth: int) -> list[bytes]:
    """A key for each prefix of seq of 0 to depth turns."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for d in range(depth):
        h.update(seq[d * DIGEST : (d + 1) * DIGEST])
        out.append(h.copy().digest())
    return out


class Point:
    """A branch, end or leaf of the compressed tree while its path is on the stack; inside is what the range alone knows."""

    __slots__ = ("depth", "n", "low", "kids", "childless", "leaves", "below", "sha", "pending")

    def __init__(self, depth: int):
        self.depth, self.n, self.low, self.kids, self.childless, self.leaves, self.below, self.sha, self.pending = depth, 0, None, 0, True, 0, 0, None, []


class Range:
    """A range of the sorted distinct sequences; before and after are the sequences beyond its borders, if there are any."""

    def __init__(self, t: pa.Table, before: bytes | None, after: bytes | None):
        seqs = t.column("seq").to_pylist()
        order = sorted(range(len(seqs)), key=seqs.__getitem__)  # a sequence comes right before its extensions
        words = t.column("words").to_pylist()
        self.seqs = [seqs[i] for i in order]
        self.words = [np.cumsum([0, *words[i]]) for i in order]  # of the first d turns
        self.n, self.low, self.sha = ([x[i] for i in order] for x in (t.column(c).to_pylist() for c in ("n", "low", "sha")))
        around, n = [before, *self.seqs, after], len(seqs)
        self.lcp = [common(a, b) for a, b in zip(around, around[1:])]  # at i: of sequence i and the one before it
        # To these depths the path of sequence i is one with the path to the border before or after the range: nodes that are shared.
        self.left = np.minimum.accumulate(self.lcp[:n]).tolist()
        self.right = np.minimum.accumulate(self.lcp[:0:-1])[::-1].tolist()
        self.keys = prefix_keys(self.seqs[0], self.lcp[0]), prefix_keys(self.seqs[-1], self.lcp[n])

    def key(self, i: int, depth: int) -> bytes:
        """Of the shared node at this depth on the path of sequence i."""
        return self.keys[0][depth] if depth <= self.left[i] else self.keys[1][depth]

    def scan(self, closed):
        """Build the compressed tree by a stack scan. closed(i, p, q, shared): p, on the path of sequence i, has all its members; q is above it.

        Every shared depth is a point, so that an edge holds either one shared node or none.
        """
        n, stack = len(self.seqs), [Point(0)]

        def fold(i: int, upto: int):
            within = max(self.left[i], self.right[i])
            while stack[-1].depth > upto:
                p = stack.pop()
                above = max(stack[-1].depth, upto, min(within, p.depth - 1))
                if stack[-1].depth < above:
                    stack.append(Point(above))
                q, shared = stack[-1], p.depth <= within
                if p.childless and (i < n - 1 or p.depth > self.lcp[n]):
                    p.leaves = 1
                closed(i, p, q, shared)
                q.n += p.n
                q.low = p.low if q.low is None else min(q.low, p.low)
                q.kids += not shared
                q.childless = False
                q.leaves += p.leaves
                q.below += p.below + self.saved(i, p, q.depth)

        for i, seq in enumerate(self.seqs):
            if i:
                fold(i - 1, self.lcp[i])
            if stack[-1].depth < len(seq) // DIGEST:
                stack.append(Point(len(seq) // DIGEST))
            p = stack[-1]
            p.n += self.n[i]
            p.low = self.low[i] if p.low is None else min(p.low, self.low[i])
            p.sha = self.sha[i]
        fold(n - 1, 0)
        closed(n - 1, stack[0], None, True)

    def saved(self, i: int, p: Point, down: int) -> int:
        """(members - 1) * words over the nodes of p's edge above depth down; a node that an earlier range met too has its own copy counted there."""
        known = p.depth <= self.left[i]
        return (p.n - (not known)) * int(self.words[i][p.depth] - self.words[i][down])

    def shared_parts(self) -> pa.Table:
        """What this range adds to each node that it shares; the root is one of them."""
        rows = []

        def closed(i, p, q, shared):
            if shared:
                own = self.saved(i, p, p.depth - 1) if p.depth else 0
                above = self.key(i, p.depth - 1) if p.depth else None
                rows.append((self.key(i, p.depth), p.depth, above, p.n, p.low, p.kids, p.leaves, p.below + own, p.sha))

        self.scan(closed)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), PART)], schema=PART)

    def nodes(self, lows: dict[bytes, int]) -> pa.Table:
        """The nodes of this range that no other shares, edges expanded; lows: the least conversation of each shared one."""
        out = tuple([] for _ in ENDED)

        def closed(i, p, q, shared):
            if shared:
                return
            w, top = self.words[i], q.depth + 1
            for k in p.pending:
                out[2][k] = p.low
            for d in range(p.depth, q.depth, -1):
                end = d == p.depth
                values = (p.low, d, p.low, p.n, p.kids if end else 1, p.leaves, p.below + (p.n - 1) * int(w[p.depth] - w[d - 1]), p.sha or NONE_SHA if end else NONE_SHA)
                if d == top:
                    if q.depth <= max(self.left[i], self.right[i]):
                        values = (*values[:2], lows[self.key(i, q.depth)], *values[3:])
                    else:
                        q.pending.append(len(out[0]))
                for c, v in zip(out, values):
                    c.append(v)

        self.scan(closed)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, ENDED)], schema=ENDED)


PART = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("above", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("sha", pa.string())])
ENDED = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODE.split(", ")])


def trie(turns: DataFrame) -> DataFrame:
    """One row a node of the prefix trie of the rebuilt conversations: see NODE for the columns. turns: (conv_id, turn, role, text)."""
    rows = materialise(rebuilt(turns).withColumn("fp", F.unhex(F.sha2("seq", 256))))
    found = ends(rows.select("fp", "conv"))
    seqs = rows.select(F.col("fp").alias("own_fp"), "conv", "seq", "words").join(found, (F.col("own_fp") == F.col("fp")) & (F.col("conv") == F.col("low")))
    seqs = materialise(seqs.select("seq", "words", "n", "low", "sha"))
    n_turns = seqs.agg(F.sum(F.size("words"))).first()[0] or 0
    ranges = max(turns.sparkSession.sparkContext.defaultParallelism, n_turns // RANGE_TURNS + 1)
    dealt = materialise(seqs.repartitionByRange(ranges, "seq").withColumn("pid", F.spark_partition_id()))
    # One row a range: its neighbours' sequences at the borders.
    order = Window.orderBy("pid")
    edges = dealt.groupBy("pid").agg(F.min("seq").alias("least"), F.max("seq").alias("most"))
    edges = materialise(edges.select("pid", F.lag("most").over(order).alias("before"), F.lead("least").over(order).alias("after")))

    def parts(key, t, edge):
        found = Range(t, edge.column("before")[0].as_py(), edge.column("after")[0].as_py()).shared_parts()
        return found.append_column("pid", pa.array([key[0].as_py()] * len(found), pa.int32()))

    schema = "key binary, depth long, above binary, n long, low long, kids long, leaves long, saved long, sha string, pid int"
    shared = materialise(dealt.groupBy("pid").cogroup(edges.groupBy("pid")).applyInArrow(parts, schema))
    whole = shared.groupBy("key").agg(F.min("depth").alias("depth"), F.min("above").alias("above"), *(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")), F.min("low").alias("low"), F.max("sha").alias("sha"))
    whole = materialise(whole)
    kids = whole.where("above is not null").groupBy(F.col("above").alias("kid_of")).agg(F.count("*").alias("more"))
    top = whole.join(kids, F.col("kid_of") == F.col("key"), "left").join(whole.select(F.col("key").alias("upper"), F.col("low").alias("upper_low")), F.col("above") == F.col("upper"), "left")
    top = top.select(
        F.col("low").alias("conv_id"), "depth", F.col("upper_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("kids") + F.coalesce("more", F.lit(0))).alias("n_children"),
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NONE_SHA)).alias("ends_sha256"),
    )
    lows = shared.select("pid", "key").join(whole.select("key", "low"), "key").groupBy("pid").agg(F.collect_list(F.struct("key", "low")).alias("lows"))

    def expanded(key, t, edge):
        lows = {x["key"]: x["low"] for x in edge.column("lows")[0].as_py()}
        return Range(t, edge.column("before")[0].as_py(), edge.column("after")[0].as_py()).nodes(lows)

    inner = dealt.groupBy("pid").cogroup(edges.join(lows, "pid").groupBy("pid")).applyInArrow(expanded, NODE)
    return top.unionAll(inner)

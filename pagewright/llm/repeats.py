"""Suffix-array deduplication: repeated byte strings of at least a given length, across all documents.

Each bucket of suffixes gets an enhanced suffix array; a stack scan of it gives the tree of common-prefix intervals, and intervals whose
occurrences differ on the left are maximal repeat groups, each with all of its occurrences. What is removed comes from these groups: an
occurrence goes as far as the deepest group around it reaches that a smaller document is in.

How suffixes meet: in every stretch of `length` bytes the leftmost least hash of its GRAM-byte grams is its anchor, so equal stretches
have equal anchors. Chunks of documents exchange anchor hashes by bucket, then, for anchors that other documents share too, digests of
the bytes around them, and last, where an anchor stands in different surroundings, those bytes. Equal surroundings are one leaf of the
tree, with all their occurrences, and are told apart by digests (BLAKE2); a chunk sends each of them once, so a passage of a third of
all documents costs a bucket one entry a chunk. Surroundings hold up to length - GRAM bytes more than length: a longer repeat is given
as overlapping groups, one around each of its anchors.

Defined results: a null text counts as empty; texts shorter than the length keep all bytes; rows with a null id keep all bytes and
aren't a source for others; rows that share an id never remove each other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, discard, materialise, small
from pagewright.llm.hashing import mix, powers

GRAM = 20
CHUNK_BYTES = 1 << 20
LEAST_BUCKETS = 64
BUCKET_BYTES = 4 << 20  # corpus bytes a bucket: about a quarter of a million anchors


def intervals(lcp: np.ndarray, least: int):
    """(depth, first, last) of each node of the common-prefix interval tree with a depth of at least least, children first."""
    stack: list[tuple[int, int]] = []  # (depth, first place)
    for i, depth in enumerate([*lcp[1:].tolist(), 0], start=1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            if top >= least:
                yield top, first, i - 1
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(data: bytes, least: int) -> list[tuple[int, list[int]]]:
    """(length, all starts) of each string of at least so many bytes that repeats in one buffer and that no byte on either side extends in all places."""
    text, starts = np.frombuffer(data, np.uint8), np.arange(max(0, len(data) - least + 1))
    left = np.concatenate(([-1], text[:-1].astype(np.int16)))[: len(starts)] if len(starts) else np.empty(0, np.int16)
    order, lcp = enhanced(text, starts, np.array([len(data)]), np.zeros(len(starts), np.int64), left, least)
    return sorted(((depth, sorted(order[a : b + 1].tolist())) for depth, a, b in maximal_groups(lcp, left[order], least)), key=lambda x: (x[1], x[0]))


# ---- the corpus


def pack(docs: DataFrame) -> DataFrame:
    """(chunk, ids, ends, text): documents (id, text) of a partition in chunks of about CHUNK_BYTES, compressed."""

    def run(batches):
        squeeze, part, n = zstandard.ZstdCompressor(LEVEL).compress, TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
            cols = [[(part << 32) | n], [np.array(ids, np.int64).tobytes()], [ends.tobytes()], [squeeze(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["chunk", "ids", "ends", "text"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode()
                ids.append(doc_id.as_py())
                texts.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield row()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield row()

    return bounded_batches(docs.select("id", "text")).mapInArrow(run, "chunk long, ids binary, ends binary, text binary")


class Chunk:
    """The anchors of one chunk of documents and the range of stretches that each anchor stands for."""

    def __init__(self, ids: bytes, ends: bytes, text: bytes, length: int):
        self.ids, self.ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        self.text, self.length = zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, int(self.ends[-1]))) if self.ends[-1] else b"", length
        a = np.frombuffer(self.text, np.uint8)
        n, wide = len(a), length - GRAM + 1
        self.at = self.lo = self.hi = np.empty(0, np.int64)
        self.hash = np.empty(0, np.uint64)
        if n < length:
            return
        up, self.down = powers(n)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(up[:n] * (a.astype(np.uint64) + np.uint64(1)), out=self.total[1:])
        gram = mix((self.total[GRAM:] - self.total[:-GRAM]) * self.down[: n - GRAM + 1])
        value, where, span = gram, np.arange(len(gram), dtype=np.int32), 1
        while span < wide:  # least over [i, i + span), the leftmost on a tie
            step = min(span, wide - span)
            right = value[step:] < value[:-step]
            where = np.where(right, where[step:], where[:-step])
            value = np.where(right, value[step:], value[:-step])
            span += step
        starts = np.concatenate(([0], self.ends[:-1]))
        size = np.maximum(0, self.ends - starts - length + 1)
        inside = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
        w = where[inside]
        if not len(w):
            return
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (inside[1:] != inside[:-1] + 1)))
        first = np.flatnonzero(new)
        self.at, self.lo = w[first].astype(np.int64), inside[first]
        self.hi = inside[np.concatenate((first[1:] - 1, [len(inside) - 1]))]
        self.hash = gram[self.at]

    def docs(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, at, side="right")]

    def own_repeats(self) -> np.ndarray:
        """Hashes that two documents of this chunk share."""
        doc = self.docs(self.at)
        order = np.lexsort((doc, self.hash))
        h, d = self.hash[order], doc[order]
        return h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])]


def low_bytes(h: np.ndarray, width: int) -> bytes:
    """The low bytes of each hash; the bucket holds further bits."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_low(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


SHORT = 5  # bytes of an anchor hash in the first exchange, which only finds candidates: a clash there costs work, not rows
LOW = np.uint64((1 << 8 * SHORT) - 1)
LEVEL = 9  # of compression


def by_bucket(h: np.ndarray, buckets: int):
    """(bucket, places) with the hashes' top bits as the bucket."""
    b = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        yield int(b[order[lo]]), order[lo:hi]


def sent_hashes(packed: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, chunk, hashes): each chunk's distinct anchor hashes."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h = np.unique(Chunk(r["ids"], r["ends"], r["text"], length).hash)
                rows = [(b, low_bytes(h[p], SHORT)) for b, p in by_bucket(h, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([r["chunk"]] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "chunk", "hashes"])

    return packed.mapInArrow(run, "bucket int, chunk long, hashes binary")


def shared_hashes(sent: DataFrame) -> DataFrame:
    """(chunk, hashes): of each chunk's hashes those that another chunk has too."""

    def run(t):
        parts = [from_low(x, SHORT) for x in t.column("hashes").to_pylist()]
        every = np.concatenate(parts)
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for chunk, h in zip(t.column("chunk").to_pylist(), parts):
            at = np.searchsorted(twice, h)
            at[at == len(twice)] = 0
            if len(twice) and len(k := h[twice[at] == h]):
                out.append((chunk, low_bytes(k, SHORT)))
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "hashes": pa.array([x for _, x in out], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "chunk long, hashes binary")


KIND = "kind string, chunk long, bucket int, id long, n_bytes long, sha string, data binary, more binary"


def surroundings(packed: DataFrame, shared: DataFrame, length: int, buckets: int) -> DataFrame:
    """Rows of three kinds: finished documents (doc), open documents with their anchors (open), and the marks of surroundings that each bucket gets (mark)."""
    asked = shared.groupBy("chunk").agg(F.collect_list("hashes").alias("hashes"))

    def run(batches):
        squeeze = zstandard.ZstdCompressor(LEVEL).compress
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["ids"], r["ends"], r["text"], length)
                known = np.concatenate([from_low(x, SHORT) for x in r["hashes"] or []] + [c.own_repeats() & LOW])
                hot = np.flatnonzero(np.isin(c.hash & LOW, known)) if len(known) else np.empty(0, np.int64)
                rows = []
                busy = set(np.searchsorted(c.ends, c.at[hot], side="right").tolist())
                starts = np.concatenate(([0], c.ends[:-1])).tolist()
                for i, (doc, lo, hi) in enumerate(zip(c.ids.tolist(), starts, c.ends.tolist())):
                    if i not in busy:
                        rows.append(("doc", r["chunk"], -1, doc, hi - lo, hashlib.sha256(c.text[lo:hi]).hexdigest(), None, None))
                if len(hot):
                    lo, hi = c.lo[hot], c.hi[hot] + length
                    mark, tail, first, group = distinct(c.text, lo, hi)
                    least = np.full(len(first), np.iinfo(np.int64).max)
                    np.minimum.at(least, group, c.docs(lo))
                    anchor = c.hash[hot[first]]
                    for b, p in by_bucket(anchor, buckets):
                        head = np.diff(p, prepend=0).astype(np.uint32).tobytes() + least[p].tobytes() + low_bytes(anchor[p], SHORT) + low_bytes(mark[p], 8) + tail[p].tobytes()
                        rows.append(("mark", r["chunk"], b, len(p), 0, None, squeeze(head), None))
                    # Of the open documents only their own bytes go on; places are shifted to them.
                    keep = sorted(busy)
                    old = np.array([starts[i] for i in keep])
                    sizes = np.array([c.ends[i] - starts[i] for i in keep])
                    shift = np.concatenate(([0], np.cumsum(sizes)[:-1])) - old
                    move = shift[np.searchsorted(old, lo, side="right") - 1]
                    text = squeeze(b"".join(c.text[starts[i] : c.ends[i]] for i in keep))
                    parts = (np.array([len(keep), len(hot), len(first)]), c.ids[keep], sizes, lo + move, hi + move, group, first, anchor.view(np.int64), least)
                    rows.append(("open", r["chunk"], -1, 0, 0, None, squeeze(np.concatenate(parts).astype(np.int64).tobytes()), text))
                cols = list(zip(*rows))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["kind", "chunk", "bucket", "id", "n_bytes", "sha", "data", "more"])

    return packed.join(asked, "chunk", "left").select("chunk", "ids", "ends", "text", "hashes").mapInArrow(run, KIND)


def distinct(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different ones among text[lo:hi]: 72 bits of their digests (8 bytes, then 1), the first place of each, and the number of each place's."""
    digests = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist()))
    d = np.frombuffer(digests, "<u8").reshape(-1, 2)
    order = np.lexsort((d[:, 1], d[:, 0]))
    new = np.concatenate(([True], (d[order[1:]] != d[order[:-1]]).any(axis=1)))
    group = np.empty(len(d), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    return d[first, 0], d[first, 1].astype(np.uint8), first, group


class Open:
    """The open documents of a chunk: anchors (lo, hi, group) and, by group of equal surroundings, first anchor, hash and least id."""

    def __init__(self, head: bytes, text: bytes):
        a = np.frombuffer(zstandard.ZstdDecompressor().decompress(head), np.int64)
        n, m, g = a[:3].tolist()
        self.ids, self.sizes, self.lo, self.hi, self.group, self.first, anchor, self.least = np.split(a[3:], np.cumsum([n, n, m, m, m, g, g]))
        self.anchor, self.ends = anchor.view(np.uint64), np.cumsum(self.sizes)
        self.text = zstandard.ZstdDecompressor().decompress(text)


def compared_marks(marks: DataFrame, leaves: bool = False) -> DataFrame:
    """(chunk, owned, asked, leaf): surroundings that a smaller document has as a whole, with its id, and those whose bytes must be compared.

    Bytes are needed only where an anchor stands in different surroundings, and then once for each of them over all chunks. leaves: also
    the chunk and number of the surroundings that stand for each one.
    """

    def run(t):
        counts, chunks = t.column("id").to_pylist(), t.column("chunk").to_pylist()
        group, least, anchor, mark, tail = [], [], [], [], []
        for h, n in zip(t.column("data").to_pylist(), counts):
            h = zstandard.ZstdDecompressor().decompress(h)
            group.append(np.cumsum(np.frombuffer(h, np.uint32, n).astype(np.int64)))
            least.append(np.frombuffer(h, np.int64, n, 4 * n))
            at = 12 * n + SHORT * n
            anchor.append(from_low(h[12 * n : at], SHORT))
            mark.append(from_low(h[at : at + 8 * n], 8))
            tail.append(np.frombuffer(h, np.uint8, n, at + 8 * n))
        group, least, anchor, mark, tail = map(np.concatenate, (group, least, anchor, mark, tail))
        order = np.lexsort((least, tail, mark, anchor))
        a, k, k2 = anchor[order], mark[order], tail[order]
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new = new_a | np.concatenate(([True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])))
        first = np.flatnonzero(new)
        head = first[np.cumsum(new) - 1]  # of each entry, the place of the least one with its surroundings
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_a))[np.cumsum(new_a) - 1]
        owner = least[order][head]
        owned = owner < least[order]
        asked = new & (kinds > 1)
        owner_of, is_owned, is_asked = np.empty_like(owner), np.empty_like(owned), np.empty_like(asked)
        owner_of[order], is_owned[order], is_asked[order] = owner, owned, asked
        out, at = {"chunk": [], "owned": [], "asked": [], "leaf": []}, 0
        if leaves:
            chunk = np.repeat(np.array(chunks, np.int64), counts)
            leaf = np.empty((len(order), 2), np.int64)
            leaf[order] = np.stack([chunk[order][head], group[order][head]]).T
        for chunk, n in zip(chunks, counts):
            p = slice(at, at + n)
            at += n
            if leaves or is_owned[p].any() or is_asked[p].any():
                out["chunk"].append(chunk)
                out["leaf"].append(np.concatenate((group[p][:, None], leaf[p]), axis=1).tobytes() if leaves else None)
                out["owned"].append(np.stack([group[p][is_owned[p]], owner_of[p][is_owned[p]]]).T.tobytes())
                out["asked"].append(group[p][is_asked[p]].tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k == "chunk" else pa.binary()) for k, v in out.items()})

    return marks.groupBy("bucket").applyInArrow(run, "chunk long, owned binary, asked binary, leaf binary")


def asked_bytes(opened: DataFrame, answers: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, chunk, id, data, more): the surroundings that answers ask for, by the bucket of their anchors; id is their number."""
    asked = answers.where("octet_length(asked) > 0").groupBy("chunk").agg(F.collect_list("asked").alias("asked"))

    def run(batches):
        squeeze = zstandard.ZstdCompressor(LEVEL).compress
        for batch in batches:
            for data, more, want, chunk in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
                c, rows = Open(data.as_py(), more.as_py()), []
                g = np.concatenate([np.frombuffer(x, np.int64) for x in want.as_py()])
                lo, hi = c.lo[c.first[g]], c.hi[c.first[g]]
                for b, p in by_bucket(c.anchor[g], buckets):
                    head = g[p].astype(np.uint32).tobytes() + c.least[g[p]].tobytes() + (hi - lo)[p].astype(np.uint8 if length < 128 else np.uint32).tobytes()
                    rows.append((b, len(p), squeeze(head), squeeze(b"".join(c.text[lo[x] : hi[x]] for x in p))))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array([chunk.as_py()] * len(rows), pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                    names=["bucket", "chunk", "id", "data", "more"],
                )

    return opened.join(asked, "chunk").select("data", "more", "asked", "chunk").mapInArrow(run, "bucket int, chunk long, id long, data binary, more binary")


def sorted_stretches(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at starts in order of their first length bytes, and whether each agrees in them with the one before it."""
    words = -(-length // 8)
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(8 * words, np.uint8))), 8)

    def key(j: int, rows: np.ndarray) -> np.ndarray:
        piece = eights[rows + 8 * j]
        piece[:, max(0, length - 8 * j) :] = 0
        return piece.view(">u8").ravel()

    # One key at a time, from the last: a stable sort by each keeps memory at a few words a suffix.
    order = np.arange(len(starts), dtype=starts.dtype)
    for j in range(words - 1, -1, -1):
        order = order[np.argsort(key(j, starts[order]).astype(np.uint64), kind="stable")]
    same = np.ones(len(starts), bool)
    same[:1] = False
    for j in range(words):
        k = key(j, starts[order])
        same[1:] &= k[1:] == k[:-1]
    return order, same


def runs_of(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each run of agreeing neighbours, the run of each place)."""
    return np.flatnonzero(~same), np.cumsum(~same) - 1


def spreads(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)) if len(first) else (values, values)


def enhanced(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes text[starts:ends[entry]] sorted to their ends, and the common prefix of each with the one before it.

    left: the byte before each suffix, -1 at the front of its text. Only suffixes that share length bytes with another are there, and of
    those none whose whole class has one byte on the left, as such a class is a repeat of the suffixes one place further left. An lcp of
    0 stands between classes.
    """
    order, same = sorted_stretches(text, starts, length)
    first, run = runs_of(same)
    low, high = spreads(left[order], first)
    fine = (np.diff(np.append(first, len(order))) > 1) & ((low != high) | (low < 0))
    keep = fine[run]
    order, run = order[keep], run[keep]
    # Now by what follows, eight bytes at a time; a text that ends comes before those that go on.
    more = ends[entry[order]].astype(np.int64) - starts[order] - length
    words = -(-int(more.max()) // 8) if len(more) else 0
    padded = np.concatenate((text, np.zeros(8 * words + length + 8, np.uint8)))
    tails = np.lib.stride_tricks.sliding_window_view(padded, max(8, 8 * words))[starts[order] + length].copy() if words else np.zeros((len(order), 8), np.uint8)
    tails[np.arange(tails.shape[1]) >= more[:, None]] = 0
    keys = [run]
    for j in range(words):
        keys += [tails[:, 8 * j : 8 * j + 8].copy().view(">u8").ravel().astype(np.uint64), np.clip(more - 8 * j, 0, 8)]
    by = np.lexsort(keys[::-1])
    order, run, tails, more = order[by], run[by], tails[by], more[by]
    differ = tails[1:] != tails[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), tails.shape[1])
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(run[1:] == run[:-1], length + np.minimum(common, np.minimum(more[1:], more[:-1])), 0)
    return order, lcp


def maximal_groups(lcp: np.ndarray, left: np.ndarray, least: int):
    """(depth, first, last) of the intervals of an enhanced suffix array whose occurrences differ on the left, children before parents."""
    # Places where the byte on the left changes, or where there is none.
    turn = np.concatenate(([0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0)))).tolist()
    none = (left < 0).tolist()
    for depth, first, last in intervals(lcp, least):
        if turn[last] > turn[first] or none[first]:
            yield depth, first, last


def reach(lcp: np.ndarray, left: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the depth of the deepest maximal group around it that a smaller document is in (0: none), and the least document there."""
    depth, owner = np.zeros(len(lcp), np.int64), np.zeros(len(lcp), np.int64)
    if not len(lcp):
        return depth, owner
    first, run = runs_of(lcp > 0)
    size = np.diff(np.append(first, len(lcp)))
    # A class whose neighbours all share equally many bytes is a single interval.
    inner = np.where(lcp > 0, lcp, np.iinfo(np.int64).max)
    low, high = np.minimum.reduceat(inner, first), np.maximum.reduceat(lcp, first)
    l_low, l_high = spreads(left, first)
    d_low, d_high = spreads(doc, first)
    flat = low == high
    whole = flat & (size > 1) & ((l_low != l_high) | (l_low < 0))
    got = whole[run] & (doc > d_low[run])
    depth[got], owner[got] = high[run][got], d_low[run][got]
    rest = np.flatnonzero((~flat & (d_low < d_high))[run])
    if len(rest):
        docs, found = doc[rest], np.zeros((2, len(rest)), np.int64)
        for d, a, b in maximal_groups(lcp[rest], left[rest], least):
            here = docs[a : b + 1]
            low_doc = here.min()
            new = np.flatnonzero((here > low_doc) & (found[0, a : b + 1] == 0)) + a
            found[0, new], found[1, new] = d, low_doc
        depth[rest], owner[rest] = found
    return depth, owner


def bucket_groups(ctx: DataFrame, length: int, groups: bool = False) -> DataFrame:
    """(chunk, runs, groups) from the surroundings of each bucket: runs are the stretches that a smaller document has, as (number of the
    surroundings, from, to, least id); groups, if asked for, all maximal repeats, as (group, bytes, number of the surroundings, offset)."""

    def run(key, t):
        open_up = zstandard.ZstdDecompressor().decompress
        chunks, heads, texts, counts = (t.column(c).to_pylist() for c in ("chunk", "data", "more", "id"))
        heads, texts = [open_up(x) for x in heads], [open_up(x) for x in texts]
        group, doc, size, owner = [], [], [], []
        kind = np.uint8 if length < 128 else np.uint32
        for i, (h, n) in enumerate(zip(heads, counts)):
            group.append(np.frombuffer(h, np.uint32, n))
            doc.append(np.frombuffer(h, np.int64, n, 4 * n))
            size.append(np.frombuffer(h, kind, n, 12 * n).astype(np.int64))
            owner.append(np.full(n, i))
        group, doc, size, owner = map(np.concatenate, (group, doc, size, owner))
        text = np.frombuffer(b"".join(texts), np.uint8)
        del texts, heads
        place = np.int32 if len(text) < 1 << 31 else np.int64  # a bucket has tens of suffixes for each surrounding: half the width, half the memory
        begin = np.cumsum(size) - size
        n = size - length + 1  # suffixes of each surrounding
        entry = np.repeat(np.arange(len(n), dtype=np.int32), n)
        offset = np.arange(len(entry), dtype=place) - np.repeat((np.cumsum(n) - n).astype(place), n)
        starts = begin.astype(place)[entry] + offset
        left = np.where(offset > 0, text[starts - 1].astype(np.int16), np.int16(-1))
        order, lcp = enhanced(text, starts, begin + size, entry, left, length)
        left, e, offset = left[order], entry[order], offset[order]
        depth, least = reach(lcp, left, doc[e], length)
        out = {"chunk": [], "runs": [], "groups": []}
        hit = np.flatnonzero(depth)
        rows = np.stack([group[e[hit]].astype(np.int64), offset[hit], offset[hit] + depth[hit] - length, least[hit]]).T
        mine, seen = owner[e[hit]], []
        if groups:
            for g, (d, a, b) in enumerate(maximal_groups(lcp, left, length)):
                p = np.arange(a, b + 1)
                seen.append(np.stack([np.full(len(p), key[0].as_py() << 32 | g), np.full(len(p), d), group[e[p]].astype(np.int64), offset[p], owner[e[p]]]).T)
        seen = np.concatenate(seen) if seen else np.empty((0, 5), np.int64)
        by, by_seen = np.argsort(mine, kind="stable"), np.argsort(seen[:, 4], kind="stable")
        cuts = np.searchsorted(mine[by], np.arange(len(chunks) + 1))
        cuts_seen = np.searchsorted(seen[by_seen, 4], np.arange(len(chunks) + 1))
        for i, chunk in enumerate(chunks):
            p, q = by[cuts[i] : cuts[i + 1]], by_seen[cuts_seen[i] : cuts_seen[i + 1]]
            if len(p) or len(q):
                out["chunk"].append(chunk)
                out["runs"].append(rows[p].tobytes())
                out["groups"].append(np.ascontiguousarray(seen[q, :4]).tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k == "chunk" else pa.binary()) for k, v in out.items()})

    return ctx.groupBy("bucket").applyInArrow(run, "chunk long, runs binary, groups binary")


def cut(open_chunks: DataFrame, answers: DataFrame, owners: DataFrame, length: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, sha) of the open documents."""
    whole = answers.select("chunk", F.col("owned").alias("o"), F.lit(None).cast("binary").alias("r"))
    runs = whole.unionAll(owners.select("chunk", F.lit(None).cast("binary"), "runs")).groupBy("chunk").agg(F.collect_list("o").alias("owned"), F.collect_list("r").alias("runs"))

    def run(batches):
        for batch in batches:
            for data, more, owned, runs in zip(*(batch.column(i) for i in range(4))):
                c = Open(data.as_py(), more.as_py())
                ids, lo, group, ends, text = c.ids, c.lo, c.group, c.ends, c.text
                # The least document of the chunk has each surrounding whole; a smaller one elsewhere may have it whole or in part.
                last = c.hi[c.first] - lo[c.first] - length
                all_of = lambda g, who: np.stack([g, np.zeros(len(g), np.int64), last[g], who]).T
                got = [all_of(np.arange(len(c.first)), c.least)]
                got += [all_of(x[:, 0], x[:, 1]) for x in (np.frombuffer(y, np.int64).reshape(-1, 2) for y in owned.as_py() or [])]
                got += [np.frombuffer(x, np.int64).reshape(-1, 4) for x in runs.as_py() or []]
                got = np.concatenate(got)
                # Every anchor of a run's group has the run.
                order = np.argsort(group, kind="stable")
                a, b = np.searchsorted(group[order], got[:, 0]), np.searchsorted(group[order], got[:, 0], side="right")
                times = b - a
                which = np.repeat(np.arange(len(got)), times)
                anchor = order[np.repeat(a, times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)] if len(which) else which
                begin = lo[anchor] + got[which, 1]
                end = lo[anchor] + got[which, 2] + length
                owner = ids[np.searchsorted(ends, begin, side="right")]
                good = got[which, 3] < owner
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, begin[good], 1)
                np.add.at(depth, end[good], -1)
                gone = np.cumsum(depth)[:-1] > 0
                raw, rows = np.frombuffer(text, np.uint8), []
                for doc, hi, k in zip(ids.tolist(), ends.tolist(), c.sizes.tolist()):
                    g = gone[hi - k : hi]
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    kept = raw[hi - k : hi][~g].tobytes()
                    rows.append((doc, k, int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(cols[4], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return open_chunks.join(runs, "chunk", "left").select("data", "more", "owned", "runs").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def met(rows: DataFrame, length: int, leaves: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """For documents (id, text): all rows of surroundings(), the open ones of them, what compared_marks() says, and the bytes that go to each bucket."""
    packed = materialise(pack(rows))
    total = packed.agg(F.sum(F.expr("octet_length(text)")) * 3).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(total // BUCKET_BYTES))
    shared = materialise(shared_hashes(sent_hashes(packed, length, buckets)))
    around = materialise(surroundings(packed, shared, length, buckets))
    discard(packed, shared)
    opened = around.where("kind = 'open'")
    answers = materialise(compared_marks(around.where("kind = 'mark'").select("bucket", "chunk", "id", "data"), leaves))
    return around, opened, answers, asked_bytes(opened, answers, length, buckets)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(group_id, n_bytes, id, start): every occurrence, in bytes, of every maximal repeat of at least length bytes that documents share.

    A repeat is maximal if nothing on its left, and nothing on its right, is the same in all occurrences, as far as the surroundings of
    an anchor go. Further occurrences in one document count. Equal surroundings as a whole are groups of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    _, opened, answers, sent = met(rows.where("id is not null"), length, leaves=True)
    found = materialise(bucket_groups(sent, length, groups=True))

    def places(batches):
        for batch in batches:
            for data, more, chunk in zip(*(batch.column(i) for i in range(3))):
                c = Open(data.as_py(), more.as_py())
                doc = np.searchsorted(c.ends, c.lo, side="right")
                cols = (np.full(len(c.lo), chunk.as_py()), c.group, c.ids[doc], c.lo - c.ends[doc] + c.sizes[doc], c.hi - c.lo)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["chunk", "number", "id", "start", "n_bytes"])

    def numbers(batches, names):
        for batch in batches:
            for chunk, data in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(data.as_py() or b"", np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), chunk.as_py()), pa.int64()), *(pa.array(x[:, i]) for i in range(len(names)))], names=["chunk", *names])

    def longs(df: DataFrame, *names: str) -> DataFrame:
        return df.mapInArrow(lambda batches: numbers(batches, names), ", ".join(f"{n} long" for n in ("chunk", *names)))

    leaf = longs(answers.select("chunk", "leaf"), "number", "leaf_chunk", "leaf_number")
    at = materialise(opened.select("data", "more", "chunk").mapInArrow(places, "chunk long, number long, id long, start long, n_bytes long").join(leaf, ["chunk", "number"]))
    twice = at.groupBy("leaf_chunk", "leaf_number").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    wholes = at.join(twice, ["leaf_chunk", "leaf_number"]).select(F.concat_ws(":", F.lit("leaf"), "leaf_chunk", "leaf_number").alias("group_id"), "n_bytes", "id", "start")
    parts = longs(found.select("chunk", "groups"), "group", "depth", "number", "offset").select("group", "depth", "offset", F.col("chunk").alias("leaf_chunk"), F.col("number").alias("leaf_number"))
    parts = parts.join(at, ["leaf_chunk", "leaf_number"]).select(F.concat_ws(":", F.lit("node"), "group").alias("group_id"), F.col("depth").alias("n_bytes"), "id", (F.col("start") + F.col("offset")).alias("start"))
    return wholes.unionAll(parts).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): each byte goes that a string of length bytes covers which a smaller document has too."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    # Exact copies of a smaller document go whole; only one of each group is searched.
    keyed = rows.where(size >= length).where("id is not null").select("id", size.alias("n_bytes"), F.sha2("text", 256).alias("key"))
    firsts = materialise(keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = materialise(keyed.join(small(firsts, firsts.count()), "key").where("id <> first").select("id", "key", "n_bytes"))
    n_copies = copies.count()
    marked = small(copies.select("id", F.col("key").alias("k")).distinct(), n_copies)
    rest = rows.where("id is not null").join(marked, (rows["id"] == marked["id"]) & (F.sha2(rows["text"], 256) == marked["k"]), "left_anti")
    around, opened, answers, sent = met(rest, length)
    owners = bucket_groups(sent, length)
    whole = around.where("kind = 'doc'").select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    opened = cut(opened, answers, owners, length)
    empty = hashlib.sha256(b"").hexdigest()
    gone = copies.select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"))
    no_id = rows.where("id is null").select("id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return whole.unionAll(opened).unionAll(gone).unionAll(no_id).withColumnRenamed("id", id_col)

"""Embedding near-duplicates: exact threshold links by dual traversal of cover trees.

Unit vectors have a cosine of at least c just if their distance is at most sqrt(2 - 2c). The vectors of a label are cut into cells,
level by level: where a bounded sample of an oversized cell has a net of few centres at half the cell's radius, each member within that
radius of its nearest centre goes to that centre's cell and the rest stay together. Cells without such a net are cut by a hash. So each
chunk is bounded, and each gets a cover tree of nested levels with halving radii. Pairs of cells, then of chunks, then of tree nodes are
dropped where their covering radii leave no room for a link; node pairs close as a whole are linked at once; what remains is compared.

Vectors without neighbours at any scale (random ones of many dimensions) can't be pruned above their chunks: then all pairs of chunks of
a label are visited, as blocks of vectors, one row a block.

Defined results: a null label links with nothing, and so do vectors that are null, zero, or hold null or non-finite components;
vectors of different lengths never link; equal vectors of a label are one class; rows with a null id link with nothing, have a null
component and are kept; different vectors that share an id share its links and component; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import components, materialise, settle_links

CHUNK_BYTES = 2 << 20  # of a chunk's vectors as doubles: 4,096 of 64 dimensions
SAMPLE = 1024  # about so many members of an oversized cell are tried for a net
FAN = 256  # centres that a cell's net may have
LEVELS = 6  # of cells, each of half the radius before
LEAF = 16
BLOCK = 512
SAFE = 1e-6  # distances near zero are off by up to 2e-7; bounds are taken with this slack
TINY = 1e-5  # nodes of this radius aren't divided
EDGES = 1 << 20  # links that a task holds before it settles them


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def net(x: np.ndarray, radius: float, most: int | None = None) -> np.ndarray | None:
    """Rows of x from the first on, each farther than radius from those taken before; None if they are more than most."""
    taken = [0]
    for lo in range(0, len(x), BLOCK):
        block = x[lo : lo + BLOCK]
        open_rows = np.flatnonzero(distances(block, x[taken]).min(axis=1) > radius)
        far = distances(block[open_rows], block[open_rows]) > radius
        alive = np.ones(len(open_rows), bool)
        for i in range(len(open_rows)):
            if alive[i]:
                taken.append(lo + int(open_rows[i]))
                alive &= far[i]
        if most is not None and len(taken) > most:
            return None
    return np.array(taken)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    at, low = np.zeros(len(x), np.int64), np.zeros(len(x))
    for lo in range(0, len(x), BLOCK):
        d = distances(x[lo : lo + BLOCK], centres)
        at[lo : lo + BLOCK], low[lo : lo + BLOCK] = d.argmin(axis=1), d.min(axis=1)
    return at, low


def grow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of a cover tree over the rows of x; nodes holds lo, hi, radius, kid, end and level of each.

    Node k has the rows order[lo:hi], all within radius of the first, its centre; its kids are the nodes kid:end. A kid of level l lies
    within 2 ** (1 - l) of its centre as a whole, centres of one parent's kids are farther apart than that, and the first kid keeps the
    parent's centre. Levels that would only repeat a node are left out.
    """
    order = np.arange(len(x))
    lo, hi, radius, level, kid, end = [0], [len(x)], [float(distances(x, x[:1]).max())], [0], [0], [0]
    i = 0
    while i < len(lo):
        a, b = lo[i], hi[i]
        if b - a > LEAF and radius[i] > TINY:
            part, depth = x[order[a:b]], level[i] + 1
            while 2.0 ** (1 - depth) >= radius[i]:
                depth += 1
            centres = net(part, 2.0 ** (1 - depth))
            at, d = nearest(part, part[centres])
            other = np.ones(b - a, bool)
            other[centres], d[centres] = False, 0
            by = np.lexsort((other, at))
            order[a:b] = order[a:b][by]
            n = np.bincount(at, minlength=len(centres))
            stop = np.cumsum(n)
            kid[i], end[i] = len(lo), len(lo) + len(n)
            lo += (a + stop - n).tolist()
            hi += (a + stop).tolist()
            radius += np.maximum.reduceat(d[by], stop - n).tolist()
            level += [depth] * len(n)
            kid += [0] * len(n)
            end += [0] * len(n)
        i += 1
    return order, np.array([lo, hi, radius, kid, end, level], np.float64)


class Tree:
    def __init__(self, x: np.ndarray, nodes: np.ndarray):
        """x: unit vectors in the tree's order."""
        self.x, self.radius = x, nodes[2]
        self.lo, self.hi, self.kid, self.end = (nodes[k].astype(np.int64) for k in (0, 1, 3, 4))
        self.size = self.hi - self.lo

    def leaf(self, k: int) -> bool:
        return self.end[k] == 0

    def kids(self, k: int) -> np.ndarray:
        return np.array([k]) if self.leaf(k) else np.arange(self.kid[k], self.end[k])


class Links:
    """Link counts (weighted by class sizes) and linked classes of two trees' rows; a tree may be paired with itself."""

    def __init__(self, s: Tree, t: Tree, ws: np.ndarray, wt: np.ndarray, cosine: float):
        self.s, self.t, self.ws, self.wt, self.cosine, self.same = s, t, ws, wt, cosine, s is t
        self.most = float(np.sqrt(2 - 2 * cosine))
        self.of_s = np.zeros(len(s.x), np.int64)
        self.of_t = self.of_s if self.same else np.zeros(len(t.x), np.int64)
        self.base = 0 if self.same else len(s.x)
        self.u, self.v, self.n = [], [], 0

    def edge(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.n += len(u)
        if self.n > EDGES:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows with a link, the least row of each one's component); rows of t are numbered after those of s."""
        none = np.empty(0, np.int64)
        node, top = settle_links(np.concatenate([none, *self.u]), np.concatenate([none, *self.v]))
        self.u, self.v, self.n = [node], [top], 0
        return node, top

    def visit(self) -> None:
        s, t, stack = self.s, self.t, [(0, 0)]
        while stack:
            a, b = stack.pop()
            if s.leaf(a) and t.leaf(b):
                self.compare(a, b)
                continue
            every, q = s.kids(a), t.kids(b)
            for k in range(0, len(every), BLOCK):
                p = every[k : k + BLOCK]
                d = distances(s.x[s.lo[p]], t.x[t.lo[q]])
                near = d <= self.most + SAFE + s.radius[p][:, None] + t.radius[q]
                if self.same and a == b:
                    near &= p[:, None] <= q
                i, j = np.nonzero(near)
                one = (s.size[p[i]] == 1) & (t.size[q[j]] == 1)
                self.pairs(s.lo[p[i[one]]], t.lo[q[j[one]]])
                for x, y, between in zip(p[i[~one]].tolist(), q[j[~one]].tolist(), d[i[~one], j[~one]].tolist()):
                    if between + s.radius[x] + t.radius[y] < self.most - SAFE:
                        self.whole(x, y)
                    else:
                        stack.append((x, y))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Rows i of s against rows j of t, one by one."""
        for lo in range(0, len(i), 1 << 14):
            x, y = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            hit = (self.s.x[x] * self.t.x[y]).sum(axis=1) >= self.cosine
            if self.same:
                hit &= x != y
            x, y = x[hit], y[hit]
            np.add.at(self.of_s, x, self.wt[y])
            np.add.at(self.of_t, y, self.ws[x])
            self.edge(x, y + self.base)

    def whole(self, a: int, b: int) -> None:
        p, q = slice(self.s.lo[a], self.s.hi[a]), slice(self.t.lo[b], self.t.hi[b])
        if self.same and a == b:
            self.of_s[p] += self.ws[p].sum() - self.ws[p]
        else:
            self.of_s[p] += self.wt[q].sum()
            self.of_t[q] += self.ws[p].sum()
        rows = np.concatenate((np.arange(p.start, p.stop), np.arange(q.start, q.stop) + self.base))
        self.edge(np.full(len(rows), p.start), rows)

    def compare(self, a: int, b: int) -> None:
        own = self.same and a == b
        for lo in range(int(self.s.lo[a]), int(self.s.hi[a]), BLOCK):
            p, q = slice(lo, min(lo + BLOCK, int(self.s.hi[a]))), slice(self.t.lo[b], self.t.hi[b])
            near = self.s.x[p] @ self.t.x[q].T >= self.cosine
            if own:
                near &= np.arange(p.start, p.stop)[:, None] < np.arange(q.start, q.stop)
            i, j = np.nonzero(near)
            np.add.at(self.of_s, i + p.start, self.wt[q][j])
            np.add.at(self.of_t, j + q.start, self.ws[p][i])
            self.edge(i + p.start, j + q.start + self.base)


def as_matrix(vectors: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks]) if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(vectors), -1)


CELL = ["label", "dim", "cell"]


def chunk_rows(dim: Column) -> Column:
    return F.greatest(F.lit(LEAF), F.floor(F.lit(CHUNK_BYTES / 8) / dim))


def chooser(radius: float, kind: str):
    """The net of a sample of a cell, one row a centre; none if FAN centres don't cover it."""

    def choose(key, t):
        key = dict(zip(CELL, (x.as_py() for x in key)))
        x = unit(as_matrix(t.column("v"), kind))
        rows = net(x, radius, FAN)
        centres = [] if rows is None else x[rows].tolist()
        return pa.table({
            **{c: pa.array([key[c]] * len(centres), t.schema.field(c).type) for c in CELL}, "child": pa.array([f"{key['cell']}/{k}" for k in range(len(centres))], pa.string()),
            "centre": pa.array(centres, pa.list_(pa.float64())),
        })

    return choose


def assigner(radius: float, kind: str):
    """The next cell of each class of a cell: that of the nearest centre within radius, else the rest; the rows with a child are the net."""

    def assign(t):
        is_net = np.array(t.column("child").is_valid())
        centres, names = t.filter(pa.array(is_net)), None
        rows = t.filter(pa.array(~is_net))
        out = pa.array([], pa.string())
        if len(rows):
            names = centres.column("child").to_pylist()
            at, d = nearest(unit(as_matrix(rows.column("v"), kind)), np.array(centres.column("centre").to_pylist()))
            own = rows.column("cell")[0].as_py() + "/rest"
            out = pa.array([names[k] if near else own for k, near in zip(at.tolist(), (d <= radius).tolist())], pa.string())
        return pa.table({**{c: rows.column(c) for c in ("label", "dim", "v", "cid", "n")}, "cell": out})

    return assign


def cells(classes: DataFrame, kind: str, vec: str) -> tuple[DataFrame, list[DataFrame]]:
    """(classes with their cell, the cells made at each level as (label, dim, parent, cell, centre, radius))."""
    now, made = classes.withColumn("cell", F.lit("c")), []
    fixed = None  # members of cells that aren't divided any more
    for level in range(1, LEVELS + 1):
        sizes = now.groupBy(*CELL).agg(F.count("*").alias("size")).where(F.col("size") > chunk_rows(F.col("dim")))
        sizes = materialise(sizes.withColumn("salts", F.ceil(F.col("size") / chunk_rows(F.col("dim"))).cast("int")))
        if sizes.isEmpty():
            break
        radius = 2.0 ** (1 - level)
        sample = now.join(sizes, CELL).where(F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / SAMPLE)) == 0).select(*CELL, "v")
        nets = materialise(sample.groupBy(*CELL).applyInArrow(chooser(radius, kind), "label string, dim int, cell string, child string, centre array<double>"))
        cut = nets.select(*CELL).distinct()
        if cut.isEmpty():
            break
        rest = now.join(cut, CELL, "left_anti")
        fixed = rest if fixed is None else fixed.unionByName(rest)
        # A cell goes to as many tasks as it has chunks; each of them gets the cell's net besides.
        salted = now.join(sizes, CELL).join(cut, CELL, "left_semi")
        a = salted.select(*CELL, F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int").alias("salt"), "v", "cid", "n", F.lit(None).cast("string").alias("child"), F.lit(None).cast("array<double>").alias("centre"))
        b = nets.join(sizes, CELL).select(*CELL, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast(vec).alias("v"), F.lit(None).cast("long").alias("cid"), F.lit(None).cast("long").alias("n"), "child", "centre")
        now = materialise(a.unionAll(b).groupBy(*CELL, "salt").applyInArrow(assigner(radius, kind), f"label string, dim int, v {vec}, cid long, n long, cell string")).select(*classes.columns, "cell")
        rest = cut.select(*CELL, F.concat("cell", F.lit("/rest")).alias("child"), F.lit(None).cast("array<double>").alias("centre"))
        made.append(nets.unionAll(rest).select("label", "dim", F.col("cell").alias("parent"), F.col("child").alias("cell"), "centre", F.lit(radius).alias("radius")))
    return (now if fixed is None else now.unionByName(fixed)), made


def reachable(most: float) -> Column:
    """Whether covering radii leave room for a link between sides a and b; a side without a centre has no bound."""
    dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) - F.col("a_radius") - F.col("b_radius") > most + SAFE
    return F.coalesce(~far, F.lit(True))


def cell_pairs(roots: DataFrame, made: list[DataFrame], most: float) -> DataFrame:
    """(label, dim, a, b) of the cells that may hold linked vectors, a <= b: both sides go down level by level."""
    nothing = (F.lit(None).cast("array<double>"), F.lit(2.0))
    now = roots.select("label", "dim", *(c.alias(f"{s}{n}") for s in "ab" for n, c in zip(("", "_centre", "_radius"), (F.lit("c"), *nothing))))
    for kids in made:
        was = now.select("label", "dim", *(F.col(f"{s}{n}").alias(f"{s}{n}0") for s in "ab" for n in ("", "_centre", "_radius")))
        for s in "ab":
            own = kids.select("label", "dim", F.col("parent").alias(f"{s}0"), F.col("cell").alias(f"{s}1"), F.col("centre").alias(f"{s}_centre1"), F.col("radius").alias(f"{s}_radius1"))
            was = was.join(own, ["label", "dim", f"{s}0"], "left")
        new = {f"{s}{n}": F.when(F.col(f"{s}1").isNull(), F.col(f"{s}{n}0")).otherwise(F.col(f"{s}{n}1")) for s in "ab" for n in ("", "_centre", "_radius")}
        was = was.select("label", "dim", "a0", "b0", *(c.alias(k) for k, c in new.items()))
        now = materialise(was.where((F.col("a0") != F.col("b0")) | (F.col("a") <= F.col("b"))).where(reachable(most)).drop("a0", "b0"))
    # The halves of a pair may have changed places on the way down.
    return now.select("label", "dim", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """(id, n_links, class_id, component_id, kept) of each row."""
    most = float(np.sqrt(2 - 2 * cosine))
    given = vectors.schema[vec_col].dataType
    exact = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    vec, kind = ("array<float>", "f4") if exact else ("array<double>", "f8")
    v = F.col(vec_col).cast(vec)
    fine = F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("fine", F.col("fine") & F.col("id").isNotNull())
    classes = materialise(rows.where("fine").groupBy("label", "v").agg(F.min("id").alias("cid"), F.count("*").alias("n")).withColumn("dim", F.size("v")))
    placed, made = cells(classes, kind, vec)

    def pack(t):
        """A chunk's classes in the order of their cover tree, as one row."""
        x = as_matrix(t.column("v"), kind)
        order, nodes = grow(unit(x))
        cols = {c: t.column(c)[:1] for c in (*CELL, "chunk")}
        data = [x[order], t.column("cid").to_numpy()[order], t.column("n").to_numpy()[order], nodes]
        return pa.table({
            **cols, "centre": pa.array(unit(x[order[:1]]).tolist(), pa.list_(pa.float64())), "radius": pa.array([float(nodes[2, 0])]),
            **{k: pa.array([np.ascontiguousarray(d).tobytes()], pa.binary()) for k, d in zip(("vs", "cids", "ns", "nodes"), data)},
        })

    sizes = placed.groupBy(*CELL).agg(F.ceil(F.count("*") / chunk_rows(F.col("dim"))).cast("int").alias("chunks"))
    dealt = placed.join(sizes, CELL).select(*CELL, F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("chunk"), "v", "cid", "n")
    packed = "label string, dim int, cell string, chunk int, centre array<double>, radius double, vs binary, cids binary, ns binary, nodes binary"
    chunks = materialise(dealt.groupBy(*CELL, "chunk").applyInArrow(pack, packed))
    known = chunks.select(*CELL, "chunk", "centre", "radius")
    pairs = cell_pairs(known.select("label", "dim").distinct(), made, most)
    for s in "ab":
        side = known.select("label", "dim", F.col("cell").alias(s), F.col("chunk").alias(f"{s}_chunk"), F.col("centre").alias(f"{s}_centre"), F.col("radius").alias(f"{s}_radius"))
        pairs = pairs.join(side, ["label", "dim", s])
    pair = ["label", "dim", "a", "a_chunk", "b", "b_chunk"]
    pairs = materialise(pairs.where((F.col("a") < F.col("b")) | (F.col("a_chunk") <= F.col("b_chunk"))).where(reachable(most)).select(*pair))
    data = ("vs", "cids", "ns", "nodes")

    def sent(s: str) -> DataFrame:
        blobs = chunks.select("label", "dim", F.col("cell").alias(s), F.col("chunk").alias(f"{s}_chunk"), *data)
        which = pairs if s == "a" else pairs.where("a <> b or a_chunk <> b_chunk")
        return which.join(blobs, ["label", "dim", s, f"{s}_chunk"]).select(*pair, F.lit(s).alias("side"), *data)

    def compare(t):
        dim, trees, cids, weights = t.column("dim")[0].as_py(), [], [], []
        for r in sorted(t.select(["side", *data]).to_pylist(), key=lambda r: r["side"]):
            trees.append(Tree(unit(np.frombuffer(r["vs"], kind).reshape(-1, dim)), np.frombuffer(r["nodes"]).reshape(6, -1)))
            cids.append(np.frombuffer(r["cids"], np.int64))
            weights.append(np.frombuffer(r["ns"], np.int64))
        links = Links(trees[0], trees[-1], weights[0], weights[-1], cosine)
        links.visit()
        node, top = links.settle()
        cid = np.concatenate(cids)
        count = links.of_s if links.same else np.concatenate((links.of_s, links.of_t))
        return pa.table({"cid": cid[node], "n": count[node], "top": cid[top]})

    found = materialise(sent("a").unionAll(sent("b")).groupBy(*pair).applyInArrow(compare, "cid long, n long, top long"))
    counts = found.groupBy("cid").agg(F.sum("n").alias("linked"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("top").alias("b"))).select(F.col("node").alias("cid"), "component")
    info = classes.join(counts, "cid", "left").join(comp, "cid", "left")
    info = info.select("label", "v", "cid", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    own = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    out = rows.where("fine").join(info, ["label", "v"]).select("id", "n_links", F.col("cid").alias("class_id"), F.col("component").alias("component_id")).unionAll(own)
    return out.select(F.col("id").alias(id_col), "n_links", "class_id", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

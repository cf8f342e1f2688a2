import numpy as np
import pytest
from pagewright.llm import cover_tree

SCHEMA = "vec_id long, embedding array<float>, label int, id int, n int, v string"


@pytest.mark.parametrize(("rows_a_chunk", "sample", "noise"), [(50, 1024, (0.0, 0.05, 0.2, 0.35, 1)), (20, 60, (0.0, 0.01, 0.05, 0.1)), (4096, 1024, (0.0, 0.05, 0.2, 0.35, 1))])
def test_against_brute_force(spark, monkeypatch, rows_a_chunk, sample, noise):
    monkeypatch.setattr(cover_tree, "CHUNK_BYTES", rows_a_chunk * 16 * 8)
    monkeypatch.setattr(cover_tree, "SAMPLE", sample)
    r = np.random.default_rng(1)
    rows = []
    for label in (0, 1, 1, 2):
        for _ in range(15):
            centre = r.normal(size=16)
            for _ in range(r.integers(1, 9)):
                x = centre + r.normal(size=16) * r.choice(noise)
                rows.append((x.astype(np.float32).tolist(), label))
    rows += [rows[0], rows[0], ([2 * x for x in rows[0][0]], 0), (rows[0][0], None), (None, 0), ([0.0] * 16, 0), ([float("nan")] + [1.0] * 15, 0), ([float("inf")] * 16, 0), ([None] + [1.0] * 15, 0), ([1.0] * 8, 0), ([], 0)]
    data = [(i, x, l, 1, 2, "") for i, (x, l) in enumerate(rows)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()}
    fine = [bool(x) and l is not None and all(c is not None and np.isfinite(c) for c in x) and any(x) for x, l in rows]
    links = np.zeros((len(rows), len(rows)), bool)
    for i, (x, l) in enumerate(rows):
        for j, (y, m) in enumerate(rows):
            if i != j and fine[i] and fine[j] and l == m and len(x) == len(y):
                a, b = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                links[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    comp = np.arange(len(rows))
    for _ in rows:
        comp = np.minimum(comp, np.where(links, comp[None], len(rows)).min(1))
    assert links.any()
    assert got == {i: (int(links[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(rows))}


def test_empty_table(spark):
    assert cover_tree.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def tree_of(n, seed, spread):
    r = np.random.default_rng(seed)
    x = np.repeat(r.normal(size=(n // 20, 8)), 20, axis=0) + r.normal(size=(n // 20 * 20, 8)) * spread
    x = cover_tree.unit(x)
    order, nodes = cover_tree.grow(x)
    return cover_tree.Tree(x[order], nodes), nodes[5], order


@pytest.mark.parametrize("spread", [0.0, 0.01, 0.3, 3.0])
def test_levels_halve_nest_cover_and_separate(spread):
    tree, level, order = tree_of(600, 3, spread)
    assert sorted(order) == list(range(600))
    for k in range(len(level)):
        rows = tree.x[tree.lo[k] : tree.hi[k]]
        d = np.sqrt(((rows - rows[0]) ** 2).sum(axis=1))
        assert abs(d.max() - tree.radius[k]) < 1e-6 and tree.radius[k] <= 2.0 ** (1 - level[k]) + 1e-6
        if not tree.leaf(k):
            kids = tree.kids(k)
            assert tree.lo[kids[0]] == tree.lo[k] and tree.hi[kids[-1]] == tree.hi[k] and (tree.lo[kids[1:]] == tree.hi[kids[:-1]]).all()
            assert (level[kids] > level[k]).all() and len(set(level[kids])) == 1 and 2.0 ** (1 - level[kids[0]]) < tree.radius[k] <= 2.0 ** (2 - level[kids[0]]) + 1e-6
            centres = tree.x[tree.lo[kids]]
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2))
            assert (apart[~np.eye(len(kids), dtype=bool)] > 2.0 ** (1 - level[kids[0]]) - 1e-6).all()


def test_few_distances_where_vectors_cluster(monkeypatch):
    tree, _, _ = tree_of(4000, 5, 0.01)
    seen = []
    plain = cover_tree.distances
    monkeypatch.setattr(cover_tree, "distances", lambda x, y: seen.append(len(x) * len(y)) or plain(x, y))
    links = cover_tree.Links(tree, tree, np.ones(4000, np.int64), np.ones(4000, np.int64), 0.93)
    links.visit()
    assert sum(seen) < 4000 * 4000 / 20
    assert (links.of_s == ((tree.x @ tree.x.T >= 0.93).sum(axis=1) - 1)).all()


def test_doubles_keep_their_size_and_null_ids_are_kept(spark):
    rows = [(1, [1e300, 2e300], 0), (2, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (4, [1.0, 2.0 + 1e-9], 0), (4, [-1.0, 1.0], 0)]
    got = cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got)[1:] == [(1, 2, 1, True), (2, 2, 1, False), (4, 2, 1, False), (4, 2, 1, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]

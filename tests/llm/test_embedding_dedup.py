import numpy as np
import pytest

from riskloom.llm import embedding_dedup as ed

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, links string"


def brute(rows):
    """links and components by comparing all with all"""
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {i: 0 for i, _, _ in rows}
    parent = {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, x, a) in enumerate(good):
        for j, y, b in good[:n]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= ed.THRESHOLD:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (links[i], root(i)) for i in links}


def make(spark, rows):
    return spark.createDataFrame([(i, v, lab, None, "x") for i, v, lab in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out, i = [], 0
    for c in range(60):
        center = rng.standard_normal(16)
        for _ in range(8):
            v = center + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3, 0.5])
            out.append((1000 - i, [float(np.float32(x)) for x in v], int(c % 3)))
            i += 1
    out += [(2000 + k, out[0][1], out[0][2]) for k in range(40)]
    out += [(1, None, 1), (2, [0.0] * 16, 1), (3, [float("nan")] + [1.0] * 15, 1), (4, [float("inf")] + [1.0] * 15, 1), (5, [None] + [1.0] * 15, 1), (6, out[0][1], None), (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1), (9, [], 1)]
    return out


@pytest.mark.parametrize("leaf,block", [(2000, 1024), (60, 1024), (60, 7)])
def test_links_and_components_equal_brute_force(spark, rows, leaf, block):
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(make(spark, rows), leaf=leaf, block=block, spill=0.1).collect()}
    want = brute(rows)
    total = sum(n for n, _ in want.values())
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * total
    if leaf == 2000:
        assert got == want


def test_null_ids_and_empty_tables(spark):
    assert ed.near_duplicates(make(spark, [])).count() == 0
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in ed.near_duplicates(make(spark, [(None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (5, [1.0, 0.01], 1)])).collect())
    assert got == [(False, 5, 2, 5), (False, 5, 2, 5), (True, 0, 2, 5)]
    assert [tuple(r) for r in ed.near_duplicates(make(spark, [(3, None, None)])).collect()] == [(3, 0, 3)]


def test_boundary_pairs_meet_in_a_leaf():
    rng = np.random.default_rng(4)
    x = ed.unit(rng.standard_normal((20_000, 64)))
    noise = rng.standard_normal((2_000, 64))
    noise -= (noise * x[:2000]).sum(1, keepdims=True) * x[:2000]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = 0.935
    y = c * x[:2000] + np.sqrt(1 - c * c) * noise
    both = np.concatenate([x, y])
    met = np.zeros(2000, bool)
    for tree in ed.fit_forest(both, len(both)):
        at = np.zeros((len(both), tree.leaves), bool)
        for leaf, members in tree.route(both):
            at[members, leaf] = True
        met |= (at[:2000] & at[20_000:]).any(1)
    assert met.mean() >= 0.98


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_of_ten_levels_with_the_default_spill(spark, kind):
    """Clustered vectors of 64 dimensions with partners at a cosine just over the threshold, in trees of ten levels."""
    rng = np.random.default_rng(6)
    n, pairs = 7000, 700
    centres = rng.standard_normal((120, 64))
    x = ed.unit(centres[rng.integers(0, 120, n)] + 0.6 * rng.standard_normal((n, 64)))
    noise = rng.standard_normal((pairs, 64))
    noise -= (noise * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    both = np.concatenate([x, 0.932 * x[:pairs] + np.sqrt(1 - 0.932**2) * noise])
    both = both.astype(np.float32).astype(float) if kind == "float" else both
    trees = ed.fit_forest(ed.unit(both), len(both), leaf=7)
    assert min(t.leaves for t in trees) >= 2**10
    placed = sum(len(rows) for t in trees for _, rows in t.route(ed.unit(both)))
    assert placed < 40 * len(both)
    unit = ed.unit(both)
    linked = unit @ unit.T >= ed.THRESHOLD
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    assert want.sum() >= 2 * pairs
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], f"vec_id bigint, embedding array<{kind}>, label int")
    got = {r.vec_id: r.n_links for r in ed.near_duplicates(frame, leaf=7).collect()}
    assert all(got[i] <= want[i] for i in range(len(both))) and sum(got.values()) >= 0.98 * want.sum()

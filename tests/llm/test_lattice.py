import numpy as np
from fleetlens.llm import lattice

from .test_linking import roots


def brute(rows, threshold=0.98):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = (label, x / np.linalg.norm(x))
    ids = sorted(good)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and float(good[a][1] @ good[b][1]) >= threshold]
    comp, links = roots(pairs), {}
    for p in pairs:
        for i in p:
            links[i] = links.get(i, 0) + 1
    return {i: (links.get(i, 0), comp.get(i, i), comp.get(i, i) == i) for i in {r[0] for r in rows if r[0] is not None}}


def run(llm, rows):
    df = llm.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    return [tuple(r) for r in lattice.near_embeddings(df).collect()]


def test_nearest_points_are_nearest():
    y = np.random.default_rng(1).normal(size=(200, 8)) * 3
    own = lattice.nearest_e8(y)
    around = own[:, None, :] + lattice.NEIGHBOURS
    assert len(np.unique(lattice.NEIGHBOURS, axis=0)) == 240
    assert (((y - own) ** 2).sum(1)[:, None] <= ((y[:, None] - around) ** 2).sum(2) + 1e-12).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    a, b = lattice.cells(x), lattice.cells(0.98 * x + np.sqrt(1 - 0.98**2) * z)
    found = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert found.mean() > 0.9999


def test_dense_groups_copies_and_odd_vectors(llm):
    rng = np.random.default_rng(3)
    f32 = lambda v: [float(x) for x in np.float32(v)]
    centre, rows = rng.normal(size=16), []
    for k in range(400):  # two blocks of one cell; many cosines lie around the threshold
        rows.append((k, f32(centre + rng.normal(size=16) * 0.13), 1))
    rows += [(1000 + k, f32(centre), 1) for k in range(50)] + [(1100, f32(3 * np.float32(centre)), 1), (1101, f32(centre), 2), (1102, f32(centre), None)]
    rows += [(1200 + k, f32(rng.normal(size=16)), k % 3) for k in range(100)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [None] + [1.0] * 15, 1), (2004, [float("nan")] + [1.0] * 15, 1), (2005, [float("inf")] + [1.0] * 15, 1)]
    rows += [(2006, [1.0, 2.0], 1), (2007, [1.0, 2.0], 1), (2008, [1e30, 2e30], 1), (2009, [-1.0, -2.0], 1)]
    assert {r[0]: r[1:] for r in run(llm, rows)} == brute(rows)


def test_repeated_and_null_ids(llm):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]
    assert sorted(run(llm, rows), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]
    assert run(llm, []) == []


def test_whole_table_against_brute_force(llm, sf):
    from fleetlens.llm.queries import op2_lattice

    rows = [tuple(r) for r in llm.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert {r[0]: tuple(r[1:]) for r in op2_lattice(llm, sf).collect()} == brute(rows)

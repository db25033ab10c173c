import numpy as np
import pandas as pd

import tidewake.llm.embedding_dedup as ed
from tidewake.llm.embedding_dedup import _calibrated, embedding_links, fit_index


def vectors(seed=0, n=400, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[:80] = x[0] + rng.normal(scale=0.25, size=(80, dims))
    x[80:120] = x[80] + rng.normal(scale=0.3, size=(40, dims))
    return x.astype("<f4")


def brute(x, ids):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    comp = {i: i for i in range(len(x))}
    for i in range(len(x)):
        stack, seen = [i], {i}
        while stack:
            for j in np.flatnonzero(link[stack.pop()]):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        comp[i] = min(ids[j] for j in seen)
    return {ids[i]: (int(link[i].sum()), comp[i]) for i in range(len(x))}


def test_links_match_brute_force_and_odd_rows_link_with_nothing(spark, monkeypatch):
    monkeypatch.setattr(ed, "PER_CELL", 40)
    monkeypatch.setattr(ed, "VISIT_COST", 1)
    monkeypatch.setattr(ed, "MEMBERS", 16)
    monkeypatch.setattr(ed, "VISITORS", 32)
    x = vectors()
    x[130] = x[3]  # equal vectors
    x[131] = x[3]
    ids = [1000 + 7 * i for i in range(len(x))]
    rows = [(i, [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)]
    odd = [(1, None, 1), (2, [0.0] * 16, 1), (3, [float("nan")] * 16, 1), (4, [None, 1.0] * 8, 1), (5, [float("inf")] * 16, 1), (6, [1.0, 2.0], 1), (7, [], 1)]
    nameless = [(None, [float(c) for c in x[0]], 1)]
    df = spark.createDataFrame(rows + odd + nameless, "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in embedding_links(df, recall=0.9999).collect()}
    want = brute(x, ids)
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i].n_links <= want[i][0] for i in ids)
    assert {i: got[i].component_id for i in ids} == {i: c for i, (_, c) in want.items()}
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    for i in range(1, 8):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)


def test_nearest_cells_are_those_of_a_full_sort():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = _calibrated(x, 6, 0.9, 0.985, rng)[0]
    k = len(index.right)
    d = ((x[:, None, :4] - index.left) ** 2).sum(2)[:, :, None] + ((x[:, None, 4:] - index.right) ** 2).sum(2)[:, None, :]
    for n in (1, 3, 10):
        near, far = index.nearest(x, n)
        assert np.allclose(far + 1, np.sort(d.reshape(50, -1), axis=1)[:, :n])
        want = np.sort(d.reshape(50, -1), axis=1)[:, :n]
        assert np.allclose(np.take_along_axis(d.reshape(50, -1), near.astype(int), axis=1), want)
    assert k == 6


def test_empty_and_linkless_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_links(df).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embedding_links(one).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_blocks_that_go_on_in_another_batch_lose_no_link():
    one = np.array([1.0, 0.0]).tobytes()
    rows, want = [], 0
    for cell, mb, vb in [(1, 0, 1), (2, 0, 0), (2, 0, 1), (2, 1, 0), (2, 1, 1), (3, 0, 1)]:
        rows += [(cell, mb, vb, 0, 100 * len(rows) + k, 1, one, cell, np.array([cell], "<i4").tobytes()) for k in range(2)]
        rows += [(cell, mb, vb, 1, 100 * len(rows) + k, 1, one, cell, None) for k in range(3)]
        want += 2 * 3
    table = pd.DataFrame(rows, columns=["cell", "mb", "vb", "role", "node", "n", "vec", "own", "visited"])
    for size in range(1, len(rows) + 1):
        out = pd.concat(ed._compare((table.iloc[i : i + size] for i in range(0, len(rows), size)), 0.9))
        assert out.loc[out["b"] < 0, "links"].sum() == want, size


def test_default_traversal_finds_links_of_every_band(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3000, 32))
    x = centres[rng.integers(0, 3000, 9000)]
    angle = np.arccos(rng.uniform(0.9, 1.0, 9000))[:, None] / 1.4
    turn = rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    x = (np.cos(angle) * x + np.sin(angle) * turn / np.linalg.norm(turn, axis=1, keepdims=True)).astype("<f4")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    index = fit_index(u, len(u), 0.9)
    assert len(index.left) > 1 and index.visits < len(index.left) ** 2
    cells = index.visited(u)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    met = (cells[a] == cells[b][:, :1]).any(axis=1) | (cells[b] == cells[a][:, :1]).any(axis=1)
    cos = (u[a] * u[b]).sum(axis=1)
    for low in (0.9, 0.92, 0.94, 0.96, 0.98):
        band = (cos >= low) & (cos < low + 0.02)
        assert band.sum() > 300 and met[band].mean() >= 0.95, (low, band.sum(), met[band].mean())
    want = np.bincount(np.concatenate([a, b]), minlength=len(x))
    got = {r.vec_id: r.n_links for r in embedding_links(spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")).collect()}
    assert sum(got.values()) >= 0.97 * want.sum() and all(got[i] <= want[i] for i in got)


def test_grid_grows_with_the_table():
    assert [ed.grid_sizes(n)[0] for n in (10, 10**6, 10**9)] == [1, 32, 989] and ed.grid_sizes(10**10)[-1] == ed.MOST_CENTROIDS

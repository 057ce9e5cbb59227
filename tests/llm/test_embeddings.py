import numpy as np
import pytest

from umbra.llm import embeddings as E

KIND = "vec_id long, embedding array<double>, label int, id long, cell int"


def table(spark, vectors, ids=None):
    ids = list(range(len(vectors))) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2) for i, v in zip(ids, vectors, strict=True)], KIND)


def by_pairs(x, threshold=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def test_against_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n, label = by_pairs(np.array([r.embedding for r in rows], dtype=np.float64))
    got = {r.vec_id: r for r in E.op8_embeddings(spark, sf_dir).collect()}
    assert [got[r.vec_id].n_links for r in rows] == n.tolist()
    assert [got[r.vec_id].component_id for r in rows] == [rows[i].vec_id for i in label]
    assert all(g.kept == (g.vec_id == g.component_id) for g in got.values())


@pytest.mark.parametrize("most", [E.MOST_CELLS, 6])
def test_many_cells_and_blocks(spark, monkeypatch, most):
    """Random vectors with pairs just above the threshold, and one large dense group, over many small cells; with few also inside cells."""
    monkeypatch.setattr(E, "MOST_CELLS", most)
    monkeypatch.setattr(E, "DEALT", 300)
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = r.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = 0.952
    y = cos * x[:400] + np.sqrt(1 - cos**2) * noise[:400]
    z = x[1000] + 0.01 * r.normal(size=(400, 64))
    every = np.concatenate([x, y, z, x[:50], x[1000:1001].repeat(200, axis=0)])
    n, label = by_pairs(every)
    monkeypatch.setattr(E, "BLOCK", 128)
    got = {g.vec_id: g for g in E.near_duplicates(table(spark, every), per_cell=64).collect()}
    links = np.array([got[i].n_links for i in range(len(every))])
    assert (links <= n).all() and links.sum() >= 0.999 * n.sum()
    planted = links[1500:1900] >= 1
    assert planted.mean() >= 0.99
    same = np.array([got[i].component_id for i in range(len(every))]) == label
    assert same.mean() >= 0.99 and (links[1900:2300] == n[1900:2300]).all()


def test_odd_rows(spark):
    v = [[1, 0], [2, 0], [1, 0], None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [], [1, 0, 0], [-1, 0], [1e300, 0]]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(table(spark, v)).collect()}
    assert got[0] == (3, 0, True) and got[1] == (3, 0, False) and got[2] == (3, 0, False) and got[11] == (3, 0, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert E.near_duplicates(table(spark, [])).count() == 0


def test_null_and_repeated_ids(spark):
    got = E.near_duplicates(table(spark, [[1, 0], [1, 0], [1, 0], [1, 0]], [5, 5, None, 7])).select("vec_id", "n_links", "component_id").collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(5, 2, 5), (5, 2, 5), (None, 0, None), (7, 2, 5)], "vec_id long, n_links long, component_id long").collect()))


def test_kmeans():
    r = np.random.default_rng(1)
    centres = E.unit(list(r.normal(size=(4, 16))))
    x = E.unit([centres[i % 4] + 0.05 * r.normal(size=16) for i in range(200)])
    got = E.spherical_kmeans(x, 4, seed=3)
    assert np.allclose(np.linalg.norm(got, axis=1), 1)
    assert (x @ got.T).max(axis=1).mean() > 0.8

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.llm import codes, neighbours
from tablesight.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, node string, key string, id string"


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "x", "x")
                                               for i, v, label in rows], SCHEMA)


def clustered(n, d=16, seed=0, spread=0.2):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(n // 6, d))
    return (centres[random.integers(0, len(centres), n)] + spread * random.normal(size=(n, d))).astype("float32")


def awkward(d=16):
    nan, inf = float("nan"), float("inf")
    return [(9001, None, 1), (9002, [0.0] * d, 1), (9003, [nan] + [1.0] * (d - 1), 1), (9004, [inf] + [1.0] * (d - 1), 1),
            (9005, [None] + [1.0] * (d - 1), 1), (9006, [], 1), (9007, [1.0, 2.0], 1), (None, [1.0] * d, 1)]


def test_nearest_are_found(vectors):
    x = clustered(600)
    x[50:80] = x[3]  # more equal vectors than are asked for
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = neighbours.search(vectors([*rows, *awkward(), rows[7], rows[20]]), F.col("vec_id") % 20 == 0, k=10).collect()
    scores = x.astype(float) @ x.astype(float).T
    hits = 0
    for q in range(0, 600, 20):
        order = [int(j) for j in np.lexsort((np.arange(600), -np.round(scores[q], 9))) if j != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and q not in {r.vec_id for r in mine}
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - scores[q, r.vec_id]) < 1e-9 for r in mine)
        hits += len(set(order) & {r.vec_id for r in mine})
    assert hits >= 0.95 * 300 and {r.query_id for r in got} == set(range(0, 600, 20))


def test_queries_that_abandon_too_much_scan_again(vectors, monkeypatch):
    x, fit = clustered(600, seed=3), neighbours.fit

    def strict(*args):  # limits as if the sample held nearer vectors
        index = fit(*args)
        index.sample = 1.3 * index.sample
        return index

    monkeypatch.setattr(neighbours, "fit", strict)
    got = neighbours.search(vectors([(i, v.tolist(), 1) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0, k=10).collect()
    assert all([r["rank"] for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == list(range(1, 11)) for q in range(0, 600, 20))
    scores = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(scores, -np.inf)
    assert sum(r.vec_id in np.argsort(-scores[r.query_id])[:10] for r in got) >= 0.95 * 300


def test_few_vectors(vectors):
    assert neighbours.search(vectors([]), F.lit(True)).count() == 0
    assert neighbours.search(vectors(awkward()[:4]), F.lit(True)).count() == 0
    assert neighbours.search(vectors([(20, [1.0, 0.0], 1)]), F.lit(True)).count() == 0
    got = neighbours.search(vectors([(20, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (2, [2.0, 0.0], None)]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 2), (2, 3)]


def expected_links(rows, cosine=0.93):
    good = [(i, np.array(v, float) / np.linalg.norm(v), label) for i, v, label in rows if label is not None]
    names = list(range(len(good)))
    links = [0] * len(good)

    def root(a):
        while names[a] != a:
            a = names[a]
        return a

    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and good[a][1] @ good[b][1] >= cosine:
                links[a] += 1
                links[b] += 1
                names[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for a in range(len(good)):
        groups.setdefault(root(a), []).append(good[a][0])
    return [(good[a][0], links[a], min(groups[root(a)])) for a in range(len(good))]


def test_links(vectors, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 40)
    x = clustered(700, spread=0.13)
    x[100:200] = x[5]
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(2000, x[5].tolist(), None), (2001, x[5].tolist(), 7)]
    got = {r.vec_id: r for r in codes.link(vectors([*rows, *awkward()])).collect() if r.vec_id is not None}
    want = expected_links(rows)
    found, all_of = sum(got[i].n_links for i, *_ in want), sum(n for _, n, _ in want)
    assert 0.97 * all_of <= found <= all_of and all(got[i].n_links <= n for i, n, _ in want)
    assert sum(got[i].component_id == c for i, _, c in want) >= 0.97 * len(want)
    for i in (2000, 2001, *range(9001, 9008)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_links_of_vectors_with_a_common_mean(vectors):
    random = np.random.default_rng(4)
    n, d, mean, cosine = 3_000, 32, 0.7, 0.94

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    one = unit(random.normal(size=(n, d)))
    across = random.normal(size=(n, d))
    across = unit(across - (across * one).sum(1, keepdims=True) * one)
    turn = (cosine - mean) / (1 - mean)
    rest = np.vstack([one, turn * one + np.sqrt(1 - turn * turn) * across])
    x = unit(np.hstack([np.full((2 * n, 1), np.sqrt(mean)), np.sqrt(1 - mean) * rest]))
    unit_x = x.astype("float32").astype(float)
    all_of = sum(int((unit(unit_x[i:i + 500]) @ unit(unit_x).T >= codes.COSINE).sum()) for i in range(0, 2 * n, 500)) - 2 * n
    found = sum(r.n_links for r in codes.link(vectors([(i, v.tolist(), 1) for i, v in enumerate(x)])).collect())
    assert all_of >= 2 * n and 0.985 * all_of <= found <= all_of


def test_codes_of_vectors_on_few_axes():
    random = np.random.default_rng(2)
    for x in (np.eye(8)[[0, 1] * 300], np.eye(8)[[0]], np.hstack([random.normal(size=(500, 2)), np.zeros((500, 6))]), random.normal(size=(9, 1))):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        learnt = codes.learn(x, 4_000)
        assert learnt.keys(x).shape == (len(x), learnt.parts)
        for one, other in codes.pairs_at(x, codes.COSINE, np.random.default_rng(1)):
            assert (learnt.keys(one) == learnt.keys(other)).any(1).mean() >= 0.97


def test_repeated_rows_and_empty_table(vectors):
    assert codes.link(vectors([])).count() == 0
    got = codes.link(vectors([(4, [1, 0], 1), (4, [1, 0], 1), (9, [1, 0.01], 1), (8, [0, 1], 1)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(4, 2, 4, True), (4, 2, 4, True), (8, 0, 8, True), (9, 2, 4, False)]


def test_one_id_with_several_vectors_and_labels(vectors):
    random = np.random.default_rng(8)
    rows = [(k, random.normal(size=64).tolist(), 1) for k in range(2, 59)]
    # Id 1 with two unrelated vectors; no pair is near.
    got = codes.link(vectors([(1, random.normal(size=64).tolist(), 1), (1, random.normal(size=64).tolist(), 1), *rows])).collect()
    assert len(got) == 59 and all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got)
    a, b, c = np.eye(3).tolist()
    near_a, near_b = [1.0, 0.05, 0.0], [0.05, 1.0, 0.0]
    # Id 5 links one way under label 1 and another under label 2, and its vector c with nothing.
    given = [(5, a, 1), (3, near_a, 1), (5, b, 2), (7, near_b, 2), (5, c, 1), (5, a, None), (9, a, 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in codes.link(vectors(given)).collect())
    assert got == sorted([(5, 1, 3, False), (3, 1, 3, True), (5, 1, 5, True), (7, 1, 5, False), (5, 0, 5, True), (5, 0, 5, True), (9, 0, 9, True)])


def test_queries(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v, _ in rows], float), np.array([i for i, *_ in rows])
    got = QUERIES["op3_neighbours"](spark, sf_dir).collect()
    hits = asked = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        asked += len(best)
        hits += len(best & {r.vec_id for r in got if r.query_id == ids[k]})
    assert hits >= 0.9 * asked
    links = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op7_codes"](spark, sf_dir).collect()}
    want = expected_links(rows)
    assert sum(links[i] == (n, c) for i, n, c in want) >= 0.97 * len(want)

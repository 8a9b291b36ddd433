import numpy as np

from quotecraft.llm import neighbours


def exact(x, k=20):
    """query -> [(vec_id, score)] over usable vectors, ties to the smaller id."""
    ids = sorted(x)
    m = np.array([x[i] for i in ids], dtype=float)
    out = {}
    for i in ids:
        s = m @ np.asarray(x[i], dtype=float)
        out[i] = [(ids[j], s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    x = {k: (centres[k % 6] + 0.4 * rng.normal(size=24)) * rng.uniform(0.5, 2) for k in range(1500)}
    x = {k: v.astype("float32") for k, v in x.items()}
    table = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "vec_id bigint, embedding array<float>")
    rows = neighbours.nearest(table, table.where("vec_id % 20 = 0")).collect()
    want, got = exact(x), {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {k for k in x if k % 20 == 0} and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in v} & {i for i, _ in want[q]}) for q, v in got.items())
    assert hits / (20 * len(got)) >= 0.95
    for q, v in got.items():
        assert [s for _, s in v] == sorted((s for _, s in v), reverse=True) and q not in {i for i, _ in v}
        assert np.allclose([s for _, s in v], [np.dot(x[q].astype(float), x[i].astype(float)) for i, _ in v], rtol=0, atol=1e-12)


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(k, [1.0, 0.0]) for k in range(0, 60)] + [(100, [0.9, 0.1]), (101, [-1.0, 0.5])]
    rows += [(200, None), (220, [0.0, 0.0]), (240, [float("nan"), 1.0]), (260, [float("inf"), 1.0]), (280, [None, 1.0]),
             (None, [1.0, 1.0]), (300, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                  "vec_id bigint, embedding array<float>, node string, score int")
    got = {}
    for r in neighbours.nearest(table, table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {0, 20, 40, 100}
    assert [got[0][k][0] for k in range(1, 21)] == list(range(1, 21))
    assert [got[20][k][0] for k in range(1, 21)] == list(range(20))
    assert [got[100][k] for k in range(1, 21)] == [(k, np.float32(0.9)) for k in range(20)]


def test_fewer_candidates_than_asked(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(table, table.where("vec_id = 0")).collect()] == [
        (0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0

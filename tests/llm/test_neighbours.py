import math

import numpy as np
import pytest

from tidewell.llm import neighbours


def brute(vectors, queries, k=5):
    """Exact nearest, ties to the smaller id; copies of a row count once."""
    good = {(i, tuple(v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i in queries:
            scored = {}
            for j, w in good:
                if j != i:
                    dot = sum(a * b for a, b in zip(v, w))
                    c = dot / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in w))
                    scored[j] = max(c, scored.get(j, -2))
            out[i] = sorted(scored.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


@pytest.fixture
def frame(spark):
    def make(rows, kind="float"):
        return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, ids string, cls string")

    return make


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_exact_with_the_whole_share(frame, kind):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=8).astype("f4")]) for i in range(300)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(40)] + [(2000, [2 * x for x in vectors[3][1]])]  # copies and a longer one
    vectors += [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [None] + [1.0] * 7), (5004, [float("nan")] * 8), (5005, [float("inf")] * 8), (None, [1.0] * 8), (5006, [1.0, 2.0])]
    vectors += vectors[:5]
    df = frame(vectors, kind)
    found = rows_of(neighbours.knn(df, df.where("vec_id % 50 = 0"), share=100.0, leaf=16))
    want = brute([v for v in vectors if not v[1] or len(v[1]) == 8], {i for i, _ in vectors if i is not None and i % 50 == 0})
    assert set(found) == set(want)
    for q, near in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in near], q
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(found[q], near))


def test_recall(frame):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    vectors = [(i, [float(x) for x in centres[i % 20] + 0.4 * rng.normal(size=32)]) for i in range(3000)]
    df = frame(vectors)
    found = rows_of(neighbours.knn(df, df.where("vec_id % 50 = 0")))
    base = np.array([v for _, v in vectors], dtype="f4").astype(float)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    hits = 0
    for q, near in found.items():
        scores = base @ base[q]
        scores[q] = -2
        hits += len({i for i, _ in near} & set(np.argsort(-scores)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(found) and len(found) == 60


def test_few_and_none(frame):
    df = frame([(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert rows_of(neighbours.knn(df, df.where("vec_id = 0"))) == {0: [(1, 0.0)]}
    assert neighbours.knn(df.where("false"), df.where("false")).count() == 0
    assert neighbours.knn(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_queue_takes_the_nearest_leaves_first():
    rng = np.random.default_rng(5)
    vectors = neighbours.unit(rng.normal(size=(500, 6)))
    trees = [neighbours.grow(vectors, rng, 20) for _ in range(3)]
    sizes = [np.bincount(t.place(vectors), minlength=t.leaves) for t in trees]
    assert all(s.max() <= 20 and s.sum() == 500 for s in sizes)
    for v in vectors[:20]:
        some = neighbours.search(trees, sizes, v, 100)
        every = neighbours.search(trees, sizes, v, 10_000)
        assert every[: len(some)] == some and len(set(every)) == len(every) == sum(t.leaves for t in trees)
        assert {(k, int(t.place(v[None])[0])) for k, t in enumerate(trees)} <= set(every[:3])


@pytest.mark.parametrize("rows", [16, 4096])
def test_ties_of_unlike_vectors_go_to_the_smaller_id(frame, monkeypatch, rows):
    """Hundreds of vectors at exactly the same angle, in one block or many; one-hot vectors that tie at 0."""
    monkeypatch.setattr(neighbours, "ROWS", rows)
    vectors = [(i, [x * 2.0 ** (i % 60 - 30) for x in (3.0, -1.0, 2.0)]) for i in range(300)]
    df = frame(vectors, "double")
    found = rows_of(neighbours.knn(df, df.where("vec_id % 50 = 0"), share=100.0, leaf=16))
    for q in range(0, 300, 50):
        assert [i for i, _ in found[q]] == [i for i in range(7) if i != q][:5]
    hot = [(i, [1.0 if j == i % 12 else 0.0 for j in range(12)]) for i in range(120)]
    df = frame(hot)
    found = rows_of(neighbours.knn(df, df.where("vec_id = 50"), k=20, share=100.0, leaf=16))
    assert [i for i, _ in found[50]] == [*range(2, 120, 12)][:4] + [*range(62, 120, 12)] + [i for i in range(120) if i % 12 != 2][:11]

import itertools
import random

import numpy as np
import pytest

from tidewell.llm import quality


def brute_repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(covered)


@pytest.mark.parametrize("seed", range(8))
def test_repeated_words(seed):
    rnd = random.Random(seed)
    words = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(0, 40))]
    assert quality.repeated(words) == brute_repeated(words)


def test_base_counts():
    found = quality.base("a# b\n\na# b\n  \nc \x85d é|\na# b")
    assert found == (9, 14, 4, 2, 0)
    assert quality.base("") == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_of_all_sequences(seed):
    rng = np.random.default_rng(seed)
    scores, move = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))

    def worth(path):
        return sum(scores[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product((0, 1), repeat=7), key=worth)
    assert tuple(quality.viterbi(scores, move)) == best


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(4, 3)), np.array([0, 1, 1, 0])
    field = quality.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))

    def likelihood(f):
        def worth(path):
            return sum(x[i] @ f.emit[:, k] for i, k in enumerate(path)) + sum(f.move[a, b] for a, b in zip(path, path[1:]))

        return worth(y) - np.log(sum(np.exp(worth(p)) for p in itertools.product((0, 1), repeat=4)))

    emit, move = quality._likelihood(field, [x], [y])
    step = 1e-6
    for part, gradient in (("emit", emit), ("move", move)):
        for at in np.ndindex(gradient.shape):
            moved = getattr(field, part).copy()
            moved[at] += step
            assert abs((likelihood(field._replace(**{part: moved})) - likelihood(field)) / step - gradient[at]) < 1e-4


def junk(text, how):
    if how == 0:
        return " ".join(w + "%%%" for w in text.split(" "))
    return " | ".join(text.split())


def test_training_tells_content_from_boilerplate(prose):
    texts = [(prose(i), True) for i in range(60)] + [(prose(100 + i, 24) + "\n" + junk(prose(200 + i), i % 2), False) for i in range(60)]
    field = quality.fit([quality.features(quality.lines_of(t)[0]) for t, _ in texts[::2]], [g for _, g in texts[::2]])
    verdicts = [(quality.content_share(field, t) >= quality.LEAST_SHARE) == g for t, g in texts[1::2]]
    assert sum(verdicts) >= 0.95 * len(verdicts)


def test_rows(spark, documents, hard_rows, prose):
    docs = documents(hard_rows + [(20, junk(prose(9, 200), 0), "a"), (21, "x y z " * 100, "a")])
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels)  # no labels: weights as they come
    found = {(r.id, r.n_words): r for r in quality.verdicts(docs, field).collect()}
    assert len(quality.verdicts(docs, field).collect()) == len(hard_rows) + 2
    kept = {i for (i, _), r in found.items() if r.kept}
    assert {1, 2, 7, None} <= kept and not kept & {3, 4, 5, 6, 20, 21}
    assert found[3, 0].base_failed and found[21, 300].n_repeat_words == 300
    out = quality.retain(docs, field)
    assert out.columns == docs.columns and out.where("doc_id = 2").count() == 2
    assert quality.retain(documents([]), field).count() == 0


def test_training_on_rows(spark, documents, prose):
    rows = [(i, prose(i) if i % 2 else junk(prose(i), 0), "a") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    field = quality.train(docs, labels)
    kept = {r.id for r in quality.verdicts(docs, field).where("kept").collect()}
    assert kept == {i for i in range(40) if i % 2}


def test_repeated_rows_train_once(spark, documents, prose):
    """An id that has most rows, with unlike texts, is one text of the sample, the same on every run."""
    rows = [(i, prose(i, 60 if i % 2 else 5), "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 1, 0)] * 20, "doc_id long, quality int, toxic int")
    often = rows + [rows[3]] * 200 + [(3, prose(90, 60), "s")] * 100
    fields = [quality.train(documents(r), labels) for r in (often, often[::-1], rows)]
    assert (fields[0].emit == fields[1].emit).all() and (fields[0].move == fields[1].move).all()
    chosen = [quality.train(documents([r for r in rows if r[0] != 3] + [(3, t, "s")]), labels) for t in (rows[3][1], prose(90, 60))]
    assert any((fields[0].emit == c.emit).all() for c in chosen)

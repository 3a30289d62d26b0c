import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixture


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    """Share by weight, cut what is above twice a source's words, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / total for s in names}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def hashed(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def brute(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    targets = brute_targets(sizes)
    out = []
    for source, target in targets.items():
        mine = sorted((hashed(i), n, i) for i, s, n in sized if s == source)
        whole = int(target // sizes[source]) if sizes[source] else 0
        budget = target - whole * sizes[source]
        below, ran = 0, 0
        for h in sorted({h for h, _, _ in mine}) if budget > 0 else []:
            step = sum(n for k, n, _ in mine if k == h)
            if ran + step > budget:
                below = h + (ran + step - budget < budget - ran)
                break
            ran += step
        out += [(i, n, sizes[source], target, n * (whole + (h < below))) for h, n, i in mine]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_plan(documents, prose, seed):
    rows = [(i, prose(i + 100 * seed, 20 + 13 * i % 170), ["a", "b", "c", "d", None][i * i % 5] if i % 3 else "hot") for i in range(90)]
    got = [(r.id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixture.plan(documents(rows)).collect()]
    assert sorted(got) == sorted((i, n, s, round(t, 6), k) for i, n, s, t, k in brute(rows))


def test_hard_rows(documents, hard_rows):
    docs = documents(hard_rows)
    got = [(r.id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixture.plan(docs).collect()]
    assert sorted(got, key=repr) == sorted(((i, n, s, round(t, 6), k) for i, n, s, t, k in brute(hard_rows)), key=repr)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)
    taken = mixture.take(docs)
    assert taken.columns == docs.columns
    assert taken.select(F.sum(mixture.words_in("text"))).first()[0] == sum(k for *_, k in got)


def test_empty_and_wordless(documents):
    assert mixture.plan(documents([])).count() == 0
    assert mixture.take(documents([])).count() == 0
    assert [(r.target, r.taken) for r in mixture.plan(documents([(1, "", "a"), (2, None, "b")])).collect()] == [(0.0, 0)] * 2


def test_reruns_agree(documents, prose):
    rows = [(i, prose(i, 60), "ab"[i % 2]) for i in range(40)]
    first, second = (sorted((r.id, r.taken) for r in mixture.plan(documents(x)).collect()) for x in (rows, rows[::-1]))
    assert first == second

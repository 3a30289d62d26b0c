import math
import random
from collections import Counter

import pytest

from tidewell.llm import toxicity

BAD = ["grubby", "vile", "rotten", "nasty"]


@pytest.fixture
def labelled(prose):
    def make(count, seed=0):
        rnd = random.Random(seed)
        rows = []
        for i in range(count):
            text, toxic = prose(1000 * seed + i, 60), int(i % 4 == 0)
            if toxic:
                words = text.split(" ")
                for w in rnd.sample(BAD, rnd.randint(1, 3)):
                    words.insert(rnd.randrange(len(words)), w.upper() + ",")
                text = " ".join(words)
            rows.append((i + 10_000 * seed, text, toxic))
        return rows

    return make


@pytest.fixture
def index(spark, documents, labelled):
    rows = labelled(240)
    docs = documents([(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, k) for i, _, k in rows] + [(None, 1, 1), (5, 1, None), (777_777, 1, 1)], "doc_id long, quality int, toxic int")
    return toxicity.learn(docs, labels)


def brute_nearest(index, text, k):
    """Cosines with every example, from the postings read one by one."""
    scores = Counter()
    for term, weight in zip(*index.vector(toxicity.terms(text))):
        for at in range(index.starts[term], index.starts[term + 1]):
            scores[int(index.places[at])] += float(weight) * float(index.weights[at])
    best = sorted(scores.items(), key=lambda x: (-round(x[1], 12), index.ids[x[0]]))[:k]
    return [(round(c, 9), p) for p, c in best if c > 0]


def nearest(index, text, k=toxicity.NEIGHBOURS):
    return [(round(c, 9), p) for c, p in next(index.nearest([index.vector(toxicity.terms(text))], k))]


@pytest.mark.parametrize("k", [1, 3, 15, 500])
@pytest.mark.parametrize("block, wide", [(2, 16), (64, 16), (5, 1), (64, 10_000)])
def test_block_max_search_is_exact(labelled, monkeypatch, k, block, wide):
    """Few or many blocks, all or no terms side by side."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "WIDE", wide)
    rows = labelled(240)
    seen = [(i, toxicity.terms(t)) for i, t, _ in rows]
    texts_of = Counter(w for _, words in seen for w in words)
    told = {w: 1.0 if w in BAD else 0.05 for w in texts_of}
    index = toxicity.build([(i, k) for i, _, k in rows], seen, texts_of, 240, told)
    assert len(index.wide) == 0 or wide > 1
    for _, text, _ in labelled(60, 3) + [(0, "", 0), (0, " ".join(BAD) + " vile vile", 1), (0, "nowhere seen", 0)]:
        assert nearest(index, text, k) == brute_nearest(index, text, k)
    many = [t for _, t, _ in labelled(150, 4)]
    found = index.nearest([index.vector(toxicity.terms(t)) for t in many], k)
    assert [[(round(c, 9), p) for c, p in f] for f in found] == [brute_nearest(index, t, k) for t in many]


def test_vectors_have_length_one(index):
    for text in ("grubby vile", "vile vile vile nasty of"):
        assert math.isclose(sum(w * w for w in index.vector(toxicity.terms(text))[1]), 1.0)


def test_unseen_texts(spark, documents, index, labelled):
    rows = labelled(80, 5)
    found = {r.id: r for r in toxicity.scores(documents([(i, t, "s") for i, t, _ in rows]), index).collect()}
    right = sum((found[i].score >= 0.5) == bool(k) for i, _, k in rows)
    assert right >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert any(":toxic:" in found[i].evidence for i, _, k in rows if k)


def test_rows(documents, hard_rows, index):
    found = toxicity.scores(documents(hard_rows), index).collect()
    assert sorted((r.id for r in found), key=repr) == sorted((i for i, _, _ in hard_rows), key=repr)
    slope, shift = index.curve
    assert {r.score for r in found if r.id in (3, 4, 5)} == {1 / (1 + math.exp(-(slope * toxicity.logit(index.base) + shift)))}
    assert toxicity.scores(documents([]), index).count() == 0


def test_one_class_or_no_labels(spark, documents, prose):
    docs = documents([(i, prose(i), "s") for i in range(5)])
    for rows in ([], [(i, 1, 0) for i in range(5)]):
        index = toxicity.learn(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert index is None
        assert {r.score for r in toxicity.scores(docs, index).collect()} == {toxicity.BASE}


def test_cosines_are_over_all_terms(spark, documents, labelled):
    """Against plain Python: document frequencies of all documents, telling factors of the examples, every term in the length."""
    rows = labelled(120) + [(900, "zyxo qwerl plimf of the river", 1), (901, "brundle snorf kettlish of the river", 0)]
    others = [(2000 + i, "of zyxo others", None) for i in range(40)] + [(3000, None, None), (3001, "", None)]
    labels = spark.createDataFrame([(i, 1, k) for i, _, k in rows], "doc_id long, quality int, toxic int")
    index = toxicity.learn(documents([(i, t, "s") for i, t, _ in rows + others]), labels)
    everywhere = Counter(w for _, t, _ in rows + others for w in toxicity.terms(t))
    n = {k: sum(x == k for _, _, x in rows) for k in (0, 1)}
    has = {k: Counter(w for _, t, x in rows if x == k for w in toxicity.terms(t)) for k in (0, 1)}

    def part(x, total):
        return x * math.log(x / total) if x else 0.0

    def told(w):
        a, b = has[1][w], has[0][w]
        found = 2 * sum(part(x, m) + part(m - x, m) for x, m in ((a, n[1]), (b, n[0]))) - 2 * (part(a + b, n[0] + n[1]) + part(n[0] + n[1] - a - b, n[0] + n[1]))
        return min(1.0, toxicity.LEAST + found / toxicity.FULL)

    def full(text):
        size = len(rows) + len(others)
        found = {}
        for w, m in toxicity.terms(text).items():
            known = has[0][w] + has[1][w] > 0
            found[w] = (1 + math.log(m)) * ((math.log((1 + size) / (1 + everywhere[w])) + 1) * told(w) if known else (math.log((1 + size) / 2) + 1) * toxicity.LEAST)
        return {w: x / math.sqrt(sum(y * y for y in found.values())) for w, x in found.items()}

    examples = {i: full(t) for i, t, _ in rows}
    for text in ["zyxo never seen words of the river", "nasty plimf", rows[3][1] + " unheard"]:
        mine = full(text)
        cosines = {i: sum(x * v.get(w, 0) for w, x in mine.items()) for i, v in examples.items()}
        best = sorted((i for i in cosines if cosines[i] > 0), key=lambda i: (-round(cosines[i], 12), i))[:15]
        assert [(int(index.ids[p]), c) for c, p in nearest(index, text)] == [(i, round(cosines[i], 9)) for i in best]
    bad, good = toxicity.judged(index, [rows[-2][1], rows[-1][1]])
    assert bad[0] >= 0.5 > good[0] and bad[1].startswith("900:toxic:1.0000")


def test_votes_and_curve_by_hand(index, labelled):
    """The score of a text from its neighbours, in plain Python."""
    text = labelled(5, 6)[0][1]
    toxic, total = toxicity.DOUBT * index.base, toxicity.DOUBT
    for c, p in brute_nearest(index, text, toxicity.NEIGHBOURS):
        weight = index.pull[bool(index.toxic[p])] * c * c / (1 - c + toxicity.SOFT)
        toxic, total = toxic + weight * bool(index.toxic[p]), total + weight
    slope, shift = index.curve
    want = 1 / (1 + (total / toxic - 1) ** slope * math.exp(-shift))
    assert math.isclose(toxicity.judged(index, [text])[0][0], want, rel_tol=1e-6)


def test_scores_are_calibrated(spark, documents, prose):
    """Words that only make a text toxic more or less often: of unseen texts as many are toxic as the scores say."""
    rnd = random.Random(9)

    def made(count, seed):
        rows = []
        for i in range(count):
            chance = rnd.choice([0.02, 0.02, 0.5, 0.9])
            word = {0.02: "calm", 0.5: "grumpy", 0.9: "vile"}[chance]
            rows.append((seed + i, f"{prose(seed + i, 20)} {word} {word}", int(rnd.random() < chance)))
        return rows

    rows, fresh = made(900, 0), made(600, 10_000)
    labels = spark.createDataFrame([(i, 1, k) for i, _, k in rows], "doc_id long, quality int, toxic int")
    index = toxicity.learn(documents([(i, t, "s") for i, t, _ in rows]), labels)
    assert math.isclose(index.base, sum(k for *_, k in rows) / len(rows))
    scores = [s for s, _ in toxicity.judged(index, [t for _, t, _ in fresh])]
    error = 0.0
    for low in range(5):
        here = [(s, k) for s, (_, _, k) in zip(scores, fresh) if low / 5 <= s < (low + 1) / 5 or (s == 1 and low == 4)]
        if here:
            error += abs(sum(s - k for s, k in here)) / len(fresh)
    assert error < 0.1


def test_blocks_below_the_bound_are_not_read(monkeypatch):
    """Blocks whose maxima cannot lift an example to the k-th best are left out, and the result stays that of all."""
    monkeypatch.setattr(toxicity, "BLOCK", 2)
    monkeypatch.setattr(toxicity, "WIDE", 1)
    rows = [(i, {"vile": 1, "nasty": 1, "all": 1} if i < 2 else {"vile": 1, f"a{i}": 9, f"b{i}": 9, "all": 1}) for i in range(12)]
    index = toxicity.build([(i, i % 2) for i in range(12)], rows, Counter(w for _, words in rows for w in words), 12)
    read = []
    spans = toxicity.spans
    monkeypatch.setattr(toxicity, "spans", lambda a, b: read.append(int((b - a).sum())) or spans(a, b))
    found = nearest(index, "vile nasty all", 2)
    assert [p for _, p in found] == [0, 1] and read[-1] < 14  # of 26 postings
    monkeypatch.setattr(toxicity, "spans", spans)
    assert found == brute_nearest(index, "vile nasty all", 2)


def test_one_example_for_an_id_and_a_bound_in_bytes(spark, documents, labelled, monkeypatch):
    """Repeated rows and unlike texts of one id: the same one text on every run; many terms: fewer examples."""
    rows = labelled(80)
    twice = rows + [(rows[1][0], "another text entirely", 0)] * 30 + [(rows[4][0], t, k) for _, t, k in rows[:3]]
    labels = spark.createDataFrame([(i, 1, k) for i, _, k in rows], "doc_id long, quality int, toxic int")
    first, second = (toxicity.learn(documents([(i, t, "s") for i, t, _ in r]), labels) for r in (twice, twice[::-1]))
    assert len(first.ids) == 80 and (first.weights == second.weights).all() and (first.places == second.places).all()
    monkeypatch.setattr(toxicity, "POSTINGS", 400)
    small = toxicity.learn(documents([(i, t, "s") for i, t, _ in rows]), labels)
    assert 2 <= len(small.ids) < 40 and len(small.places) <= 400 and small.toxic.any() and not small.toxic.all()
    monkeypatch.setattr(toxicity, "WIDE_BYTES", 8 * 80 * 3)
    assert len(toxicity.learn(documents([(i, t, "s") for i, t, _ in rows]), labels).wide) <= 3 * 80 // len(small.ids)

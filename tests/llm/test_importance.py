import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidewell.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, most=1):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, most=1, percent=10, least=20, buckets=10_000):
    """(id, n_features, weight, score, rank) of each row, with zlib and plain sorting."""
    of = {i: [zlib.crc32(f.encode()) % buckets for f in features(t, most)[1]] for i, (_, t) in enumerate(rows)}
    s, t = Counter(b for found in of.values() for b in found), Counter(zlib.crc32(f.encode()) % buckets for x in target for f in features(x, most)[1])
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))

    out = []
    for i, (doc_id, text) in enumerate(rows):
        weight = sum(map(gain, of[i])) // len(of[i]) if of[i] else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(of[i]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [i for i, (_, text) in enumerate(rows) if len(features(text)[0]) >= least]
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for place, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][4] = place
    return sorted(map(tuple, out), key=str)


def test_crcs_equal_the_library():
    rnd = random.Random(3)
    made = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(0, 70), 127, 128, 129, 1000, 4096, 100_003]]
    assert importance.crcs(made).tolist() == [zlib.crc32(f) for f in made]
    assert importance.crcs([]).tolist() == []


def test_a_word_of_many_megabytes_takes_no_byte_loop():
    word = b"ab3" * 4_000_000
    assert importance.crcs([word]).tolist() == [zlib.crc32(word)]


@pytest.mark.parametrize("most", [1, 3])
def test_memory_and_slices_change_nothing(monkeypatch, prose, most):
    texts = [prose(1, 300), None, "", "x" * 500 + " " + prose(2, 900), prose(1, 300), "é" * 30 + " ü1 A"]
    want = [Counter(zlib.crc32(f.encode()) % 997 for f in features(t, most)[1]) for t in texts]
    for memory, keep, slice_ in ((400_000, 64, 1 << 22), (50, 5, 1 << 22), (50, 64, 100), (7, 64, 1)):
        monkeypatch.setattr(importance, "MEMORY", memory)
        monkeypatch.setattr(importance, "KEEP", keep)
        monkeypatch.setattr(importance, "SLICE", slice_)
        hasher = importance.Hasher(997, most)
        for _ in range(2):
            found, words = [Counter() for _ in texts], Counter()
            for place, n, own in hasher.texts(texts):
                found[place].update(own.tolist())
                words[place] += n
            assert found == want
            assert [words[i] for i in range(len(texts))] == [len(features(t)[0]) for t in texts]


@pytest.mark.parametrize("most", [1, 2])
def test_against_brute_force(spark, documents, hard_rows, prose, most):
    rows = [(i, t) for i, t, _ in hard_rows] + [(100 + i, prose(i % 40, 25 + i % 7)) for i in range(150)] + [(7, prose(9, 40))] * 30 + [(None, prose(9, 40))] * 3
    target = [prose(s, 60) for s in (3, 4, 5)] + [None, ""]
    docs = documents([(i, t, "a") for i, t in rows])
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    found = importance.ranked(docs, goal, most=most)
    got = sorted([(r.id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()], key=str)
    assert got == brute(rows, target, most)


def test_draw_gives_whole_rows(spark, documents, prose):
    docs = documents([(i, prose(i, 30), "a") for i in range(40)] + [(1, "short", "a")])
    goal = spark.createDataFrame([(1, prose(2, 30))], "item_id long, text string")
    drawn = importance.draw(docs, goal)
    assert drawn.columns == docs.columns
    want = {r[0] for r in brute([(i, prose(i, 30)) for i in range(40)] + [(1, "short")], [prose(2, 30)]) if r[4]}
    assert {r.doc_id for r in drawn.collect()} == want and len(want) == 4


def test_equal_rows_spread_and_all_count(spark, documents, prose):
    """A third of all rows are one document; each is ranked by itself."""
    docs = documents([(1, prose(1, 30), "a")] * 50 + [(i, prose(i, 30), "a") for i in range(2, 102)])
    goal = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    ranks = sorted(r["rank"] for r in importance.ranked(docs, goal).where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, 16))


def test_empty_tables(spark, documents, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.ranked(documents([]), none).count() == 0
    rows = importance.ranked(documents([(i, prose(i, 30), "a") for i in range(20)]), none).collect()
    assert len(rows) == 20 and sum(r["rank"] is not None for r in rows) == 2
    assert importance.draw(documents([]), none).count() == 0

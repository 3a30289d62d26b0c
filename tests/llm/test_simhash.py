import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidewell.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Smallest id reachable, over all pairs."""
    fps = [brute_fingerprint(t) for _, t in rows]
    out = []
    for start in range(len(rows)):
        seen, stack = {start}, [start]
        while stack:
            a = stack.pop()
            near = [b for b in range(len(rows)) if b not in seen and (fps[a] ^ fps[b]).bit_count() <= 2]
            seen.update(near)
            stack += near
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        out.append((rows[start][0], fps[start], min(ids, default=None)))
    return out


def test_fingerprint(prose):
    for text in (None, "", "one", "One two", "A b C", prose(1), prose(2, 1000), "É É é " * 9):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
        assert simhash.fingerprint(text, block=7) == brute_fingerprint(text)


def test_bk_tree_finds_all():
    rnd = random.Random(1)
    centre = rnd.getrandbits(64)
    values = list({centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(100)})
    tree = simhash.BKTree(values)
    for query in values[:60] + [rnd.getrandbits(64)]:
        want = {v for v in values if (v ^ query).bit_count() <= 2}
        assert {values[n] for n in tree.search(query, 2)} == want
        _, node = tree.search_many(np.array([query], dtype=np.uint64), 2)
        assert {values[n] for n in node.tolist()} == want


@pytest.mark.parametrize("shard_rows", [3, 2048])
def test_links_join_what_all_pairs_join(spark, shard_rows):
    rnd = random.Random(2)
    values = [0, 1, 3, 7, 15, (1 << 64) - 1]  # a chain, and an end of the range
    for _ in range(12):
        centre = rnd.getrandbits(64)
        values += [centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) for _ in range(12)]
    values = sorted(set(values))
    signed = [int(v) for v in np.array(values, dtype=np.uint64).view(np.int64)]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, shard_rows)
    roots = {r.u: r.root for r in simhash.contract(edges).collect()}
    groups = defaultdict(set)
    for v in signed:
        groups[roots.get(v, v)].add(v)
    mine = {frozenset(g) for g in groups.values()}
    want = {frozenset(int(np.array([x], dtype=np.uint64).view(np.int64)[0]) for x in _reach(values, v)) for v in values}
    assert mine == want


def _reach(values, start):
    seen, stack = {start}, [start]
    while stack:
        a = stack.pop()
        near = [b for b in values if b not in seen and (a ^ b).bit_count() <= 2]
        seen.update(near)
        stack += near
    return seen


def test_rows(documents, hard_rows):
    found = simhash.components(documents(hard_rows)).collect()
    got = [(r.id, r.fp % (1 << 64), r.component) for r in found]
    assert sorted(got, key=repr) == sorted(brute_components([(i, t) for i, t, _ in hard_rows]), key=repr)


def test_one_of_each_component_stays(documents, hard_rows):
    docs = documents(hard_rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_components([(i, t) for i, t, _ in hard_rows])}
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == sorted((c is None, c) for c in want)


def test_empty_and_nameless(documents, prose):
    assert simhash.components(documents([])).count() == 0
    assert simhash.keep_one(documents([(None, prose(1), "a"), (None, prose(1), "a")])).count() == 1

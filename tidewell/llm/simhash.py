"""SimHash near-duplicate detection with BK-trees.

A text is lower-cased (A-Z only), cut into words at ASCII white space and into shingles of
`words` words, repeats included. Each shingle's XXH64 (seed 42) votes on 64 bits; a bit of the
fingerprint is 1 if it is set in over half of the hashes. Fingerprints within `radius` differing
bits are linked, and linked fingerprints form components.

How pairs are found. Two fingerprints at most `radius` bits apart are equal in at least one of
`radius` + 1 bands of bits, so the band's value is the shard: each shard's BK-tree (children keyed by
their Hamming distance to the parent) is sent to the fingerprints with the same band value only, and
a search follows only edges within the radius. Shards over `shard_rows` are cut into several trees of
bounded size, each sent to every block of the shard's queries. A shard gives back a spanning forest,
never all pairs; forests are merged by star contraction on written tables.

Defined results: a null or blank text has fingerprint 0, which links like any other; a text with
fewer words than a shingle is one shingle; equal texts share a fingerprint, and only distinct
fingerprints are searched; repeated rows stay; rows with a null id take part, and a component
without any id has component null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, small_batches

SEED, BITS = 42, 64
LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set: 8 bits at a time in the bytes of one word, 255 words a sum."""
    counts = np.zeros(BITS, dtype=np.int64)
    padded = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)
    padded[: len(hashes)] = hashes
    for k in range(8):
        lanes = ((padded >> np.uint64(k)) & LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[k::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, words: int = 3, block: int = 100_000) -> int:
    """The fingerprint as an unsigned number; long texts are hashed a block of shingles at a time."""
    from xxhash import xxh64_intdigest as digest

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return digest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(first), block):
        spans = zip(first[at : at + block], last[at : at + block])
        counts += bit_counts(np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64))
    bits = np.flatnonzero(counts * 2 > len(first))
    return sum(1 << int(b) for b in bits)


def fingerprint_of(text_col: str, words: int = 3) -> Column:
    """The fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64), dtype="int64")

    return run(F.col(text_col))


class BKTree:
    """A tree over distinct 64-bit numbers; a child's key is its Hamming distance to its parent."""

    def __init__(self, values: list[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for value in values:
            self.add(value)
        self._flat: tuple | None = None

    def add(self, value: int) -> None:
        node, at = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while at:
            distance = (self.values[node] ^ value).bit_count()
            following = self.children[node].setdefault(distance, at)
            if following == at:
                return
            node = following

    def search(self, value: int, radius: int) -> list[int]:
        """Places of the numbers within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            stack += [n for d, n in self.children[node].items() if abs(d - distance) <= radius]
        return found

    def flat(self) -> tuple:
        if self._flat is None:
            sizes = np.fromiter(map(len, self.children), np.int64, len(self.children))
            edges = [e for c in self.children for e in c.items()]
            keys, nodes = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
            self._flat = np.array(self.values, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)]), keys, nodes
        return self._flat

    def search_many(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) places within the radius, by levels of the tree."""
        values, starts, keys, nodes = self.flat()
        out_q, out_n = [], []
        query, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        while len(query):
            distance = np.bitwise_count(values[node] ^ queries[query]).astype(np.int64)
            near = distance <= radius
            out_q.append(query[near])
            out_n.append(node[near])
            count = starts[node + 1] - starts[node]
            parent = np.repeat(np.arange(len(node)), count)
            edge = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count) + starts[node][parent]
            follow = np.abs(keys[edge] - distance[parent]) <= radius
            query, node = query[parent[follow]], nodes[edge[follow]]
        return np.concatenate(out_q), np.concatenate(out_n)


def find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(tree_values: list[int], query_values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (number, root) that join what the tree brings within the radius of the queries."""
    if len(tree_values) == 1 and len(query_values) <= 2:
        root = tree_values[0]
        return [(q, root) for q in query_values if q != root and (q ^ root).bit_count() <= radius]
    tree, parent = BKTree(tree_values), {}
    if len(tree_values) <= 16:
        links = ((q, tree.values[n]) for q in query_values for n in tree.search(q, radius))
    else:
        links = _bulk(tree, query_values, radius)
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := find(parent, x)) != x]


def _bulk(tree: BKTree, query_values: list[int], radius: int, block: int = 128) -> Iterator[tuple[int, int]]:
    for at in range(0, len(query_values), block):
        part = query_values[at : at + block]
        query, node = tree.search_many(np.array(part, dtype=np.uint64), radius)
        for q, n in zip(query.tolist(), node.tolist()):
            if part[q] != tree.values[n]:
                yield part[q], tree.values[n]


def bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bands of bits."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(fps: DataFrame, radius: int = 2, shard_rows: int = 2048) -> DataFrame:
    """`u`, `v`: links whose components are those of all pairs of the distinct `fp` within the radius."""
    cut = [
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("value"))
        for i, (a, w) in enumerate(bands(radius))
    ]
    sharded = fps.select("fp", F.explode(F.array(*cut)).alias("s")).select("fp", "s.band", "s.value")
    sizes = sharded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    trees = F.ceil(F.col("size") / shard_rows).cast("int")
    sent = (
        sharded.join(sizes, ["band", "value"])
        .withColumn("trees", trees)
        .withColumn("slot", F.pmod(F.xxhash64("fp"), "trees").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .select("band", "value", F.least("slot", "other").alias("tree"), F.greatest("slot", "other").alias("block"), "slot", "fp")
    )
    key = ["band", "value", "tree", "block"]
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, key):
            values = group["fp"].to_numpy().view(np.uint64).tolist()
            tree_no, block_no = int(group["tree"].iat[0]), int(group["block"].iat[0])
            slots = group["slot"].tolist()
            members = [v for v, s in zip(values, slots) if s == tree_no]
            asked = [v for v, s in zip(values, slots) if s == block_no]
            if members and asked and (found := forest(members, asked, radius)):
                pairs = np.array(found, dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return sent.repartition(parts, *key).sortWithinPartitions(*key).mapInPandas(run, "u long, v long").distinct()


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with the same key; the rows come sorted by it. A run is bounded by its maker."""
    rest = None
    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
        for a, b in zip(starts, starts[1:]):
            yield frame.iloc[a:b]
        rest = frame.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


def contract(edges: DataFrame) -> DataFrame:
    """`u`, `root`: each linked number and the smallest of its component (numbers are signed longs).

    Alternates large and small stars (each node hands its neighbours to the smallest of them) until the
    links no longer change. Every step is a grouped minimum and a join, written to the shared folder.
    """

    def star(linked: DataFrame, both: bool) -> DataFrame:
        turned = linked.select(F.col("v").alias("u"), F.col("u").alias("v"))
        around = linked.unionAll(turned) if both else linked.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = around.join(least, "u")
        moved = near.where("v > u" if both else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not both:
            moved = moved.unionAll(least.select("u", F.col("m").alias("v")))
        return moved.where("u != v").distinct()

    def mark(linked: DataFrame) -> tuple:
        return tuple(linked.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    linked = materialise(edges, "links")
    before = mark(linked)
    while before[0]:
        linked = materialise(star(star(linked, True), False), "stars")
        now = mark(linked)
        if now == before:
            break
        before = now
    return linked.select("u", F.col("v").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """`id`, `fp`, `root`, `component` for each row: the fingerprint, the fingerprint that names its
    component, and the smallest id of all rows that links reach."""
    small_batches(docs.sparkSession)
    marked = docs.select(F.col(id_col).alias("id"), fingerprint_of(text_col, words).alias("fp"))
    marked = materialise(marked, "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = contract(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root")
    return marked.join(named.select("fp", "root", "component"), "fp").select("id", "fp", "root", "component")


def hex16(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row of `docs` for each component: that with the smallest id.

    Repeated rows stay once. Should several texts share the smallest id, each stays once. A component without
    any id keeps one of its rows.
    """
    found = components(docs, id_col, text_col, words, radius)
    kept = found.where("id = component").select(F.col("id").alias(id_col)).distinct()
    rows = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col, text_col])
    nameless = found.where("component IS NULL").select("fp", "root").distinct()
    own, fp, root = fresh("own", "fp", "root")
    nameless = nameless.select(F.col("fp").alias(fp), F.col("root").alias(root))
    others = docs.where(F.col(id_col).isNull()).withColumn(own, fingerprint_of(text_col, words))
    others = others.join(nameless, F.col(own) == F.col(fp)).dropDuplicates([root])
    return rows.select(docs.columns).unionAll(others.select(docs.columns))

"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

A tree splits unit vectors at the median of their projection on a random direction (of `TRIES` directions the one with the widest spread)
until a leaf has at most `LEAF` sample vectors. The forest is fitted on a bounded sample: the `SAMPLE` distinct vectors with
the smallest hash. Every vector is then indexed: it lies in one leaf of each tree. Planes and leaf sizes are broadcast; their number
is bounded by `TREES` x 2 x SAMPLE / LEAF.

A query descends all trees through a shared priority queue of the branches not taken, by their distance to the splitting plane, until the leaves found
hold `SHARE` of all vectors (rows of several trees counted each time). Candidates are reranked by the exact cosine in double precision,
leaf by leaf: a leaf's vectors are dealt into blocks of about `ROWS`, each block meets its queries in one task that holds
the block and streams the queries. A query keeps its best few of each block. `SHARE` sets recall: vectors without
any structure need a large share, vectors in tight groups much less.

Equal vectors are one index entry with its smallest ids, as many as a result can hold, so a group of copies of any size is compared once.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id or vectors
whose number of components is not the most frequent (on a tie: the smaller); equal scores go to the smaller id; a repeated row counts once;
with fewer candidates than asked for all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TREES, LEAF, SAMPLE, TRIES = 8, 64, 20_000, 8
SHARE, ROWS = 0.8, 4096
#: What rounding may change in a rough score, and how many pairs are scored exactly at a time.
ROUGH, PAIRS = 1e-9, 1 << 16
SEED = 7


class Tree(NamedTuple):
    """Inner nodes: direction (row of `planes`), threshold, children; a child below 0 is leaf -child - 1."""

    planes: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        if not len(self.at):
            return np.zeros(len(vectors), dtype=np.int64)
        over = vectors @ self.planes.T > self.at
        node = np.zeros(len(vectors), dtype=np.int64)
        inner = np.arange(len(vectors))
        while len(inner):
            here = node[inner]
            node[inner] = np.where(over[inner, here], self.right[here], self.left[here])
            inner = inner[node[inner] >= 0]
        return -node - 1


def grow(vectors: np.ndarray, rng: np.random.Generator, leaf: int = LEAF, tries: int = TRIES) -> Tree:
    planes, at, left, right = [], [], [], []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            ways = rng.standard_normal((tries, vectors.shape[1]))
            ways /= np.linalg.norm(ways, axis=1, keepdims=True)
            spread = vectors[rows] @ ways.T
            best = int(spread.std(axis=0).argmax())
            cut = float(np.median(spread[:, best]))
            over = spread[:, best] > cut
            if over.any() and not over.all():
                node = len(at)
                planes.append(ways[best])
                at.append(cut)
                left.append(0)
                right.append(0)
                left[node] = split(rows[~over])
                right[node] = split(rows[over])
                return node
        leaves += 1
        return -leaves

    split(np.arange(len(vectors)))
    return Tree(np.array(planes), np.array(at), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), leaves)


def search(trees: list[Tree], sizes: list[np.ndarray], vector: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) of the nearest leaves of all trees that together hold `wanted` rows, through one queue."""
    margins = [vector @ t.planes.T - t.at if len(t.at) else t.at for t in trees]
    queue = [(0.0, k, 0 if len(t.at) else -1) for k, t in enumerate(trees)]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and held < wanted:
        bound, k, node = heapq.heappop(queue)
        tree = trees[k]
        while node >= 0:
            margin = float(margins[k][node])
            near, far = (tree.right[node], tree.left[node]) if margin > 0 else (tree.left[node], tree.right[node])
            heapq.heappush(queue, (max(bound, abs(margin)), k, int(far)))
            node = int(near)
        found.append((k, -node - 1))
        held += int(sizes[k][-node - 1])
    return found


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of very small or large components stay in range
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id`, `vec` of the rows that take part."""
    vec, kind = F.col("vec"), rows.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # single precision is kept in shuffles; sums are in double
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vec")).where(F.col("id").isNotNull() & fine)
    usual = found.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.where(F.size("vec") == (usual["n"] if usual else 0))


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """`cls`, `ids`, `vec`: each distinct vector with its smallest ids; `cls` is the smallest."""
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= keep)
    grouped = few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return grouped.select(F.element_at("ids", 1).alias("cls"), "ids", "vec")


def fit(entries: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> list[Tree]:
    rows = entries.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("vec").collect()
    vectors = unit(np.array([r.vec for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))
    rng = np.random.default_rng(SEED)
    return [grow(vectors, rng, leaf) for _ in range(trees)]


def knn(rows: DataFrame, query_rows: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k nearest found of each query (rows like `rows`, of which they may be some)."""
    import pyarrow as pa

    spark = rows.sparkSession
    entries = materialise(distinct(valid(rows, id_col, vector_col), k + 1), "vectors")
    asked = valid(query_rows, id_col, vector_col).withColumnRenamed("id", "query_id").distinct()
    queries = materialise(asked.select("vec").distinct().select(F.xxhash64("vec").alias("q"), "vec"), "queries")
    forest = fit(entries, trees, leaf)
    sent = spark.sparkContext.broadcast(forest)

    def count(batches: Iterator) -> Iterator:
        found = [np.zeros(t.leaves, dtype=np.int64) for t in sent.value]
        for batch in batches:
            vectors = unit(matrix(batch.column(0))) if batch.num_rows else None
            for n, tree in zip(found, sent.value):
                if vectors is not None:
                    n += np.bincount(tree.place(vectors), minlength=tree.leaves)
        for k_, n in enumerate(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k_), pa.int32()), pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], names=["tree", "leaf", "n"])

    counted = entries.select("vec").mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()
    sizes = [np.zeros(t.leaves, dtype=np.int64) for t in forest]
    for r in counted:
        sizes[r.tree][r.leaf] = r.n
    total = int(sizes[0].sum())
    blocks = [np.maximum(1, -(-n // ROWS)) for n in sizes]
    held = spark.sparkContext.broadcast((sizes, blocks))
    key = ["tree", "leaf", "block"]

    def emit(batch, trees_, leaves, block, row, kind):
        take = pa.array(row)
        ids = batch.column("ids").take(take) if kind else pa.nulls(len(row), pa.list_(pa.int64()))
        name = batch.column("cls" if kind else "q").take(take)
        columns = [pa.array(trees_, pa.int32()), pa.array(leaves, pa.int32()), pa.array(block, pa.int32()), pa.array(np.full(len(row), 1 - kind), pa.int32()), name, ids, batch.column("vec").take(take)]
        return pa.RecordBatch.from_arrays(columns, names=[*key, "kind", "name", "ids", "vec"])

    vec = entries.schema["vec"].dataType.simpleString()

    def index(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                vectors = unit(matrix(batch.column("vec")))
                names = batch.column("cls").to_numpy()
                for k_, tree in enumerate(sent.value):
                    leaves = tree.place(vectors)
                    block = (names * 2654435761 % 2**31) % held.value[1][k_][leaves]
                    yield emit(batch, np.full(len(leaves), k_), leaves, block, np.arange(len(leaves)), 1)

    def probe(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                out = []
                for row, vector in enumerate(unit(matrix(batch.column("vec")))):
                    for k_, leaf_ in search(sent.value, held.value[0], vector, share * total):
                        out += [(k_, leaf_, b, row) for b in range(int(held.value[1][k_][leaf_]))]
                    if len(out) > 20_000:
                        yield emit(batch, *map(np.array, zip(*out)), 0)
                        out = []
                if out:
                    yield emit(batch, *map(np.array, zip(*out)), 0)

    shape = "tree int, leaf int, block int, kind int, name long, ids array<long>, vec " + vec
    both = entries.mapInArrow(index, shape).unionAll(queries.mapInArrow(probe, shape))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = both.repartition(parts, *key).sortWithinPartitions(*key, "kind")

    def rerank(batches: Iterator) -> Iterator:
        now, names, ids, vectors, lengths = None, [], [], [], None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in (*key, "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), tuple(where[a, :3])
                if where[a, 3] == 0:
                    if here != now:
                        now, names, ids, vectors = here, [], [], []
                    names += part.column("name").to_pylist()
                    ids += part.column("ids").to_pylist()
                    vectors.append(matrix(part.column("vec")))
                elif here == now:
                    block = np.concatenate(vectors)
                    vectors = [block]
                    yield from _best(part, np.array(names), ids, block, k + 1)

    def _best(part, names, ids, block, keep):
        """The `keep` nearest classes of the block for each query, ties to the smaller: all whose rough score could be among them are scored exactly."""
        sizes_ = np.sqrt((block * block).sum(axis=1))
        for at in range(0, part.num_rows, 256):
            some = part.slice(at, 256)
            asked_ = matrix(some.column("vec"))
            lengths = np.sqrt((asked_ * asked_).sum(axis=1))
            rough = asked_ @ block.T / sizes_ / lengths[:, None]
            few = min(keep, len(names))
            least = np.partition(rough, len(names) - few, axis=1)[:, len(names) - few] - ROUGH
            row, near = np.nonzero(rough >= least[:, None])
            exact = np.concatenate([
                (block[near[i : i + PAIRS]] * asked_[row[i : i + PAIRS]]).sum(axis=1) / (lengths[row[i : i + PAIRS]] * sizes_[near[i : i + PAIRS]])
                for i in range(0, len(row), PAIRS)
            ])
            order = np.lexsort((names[near], -exact, row))
            place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            best = order[place < few]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.column("name").to_numpy()[row[best]]), pa.array(names[near[best]]), pa.array([ids[i] for i in near[best]], pa.list_(pa.int64())), pa.array(exact[best])],
                names=["q", "cls", "ids", "score"],
            )

    ranked = laid.mapInArrow(rerank, "q long, cls long, ids array<long>, score double")
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    entries_of = ranked.groupBy("q", "cls").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    entries_of = entries_of.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    candidates = entries_of.select("q", "score", F.explode("ids").alias("vec_id"))
    best_ids = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    candidates = candidates.withColumn("n", F.row_number().over(best_ids)).where(F.col("n") <= k + 1)
    named = asked.select("query_id", F.xxhash64("vec").alias("q")).join(candidates, "q").where("query_id != vec_id")
    mine = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    out = named.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

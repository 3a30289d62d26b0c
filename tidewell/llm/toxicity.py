"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

Examples are a bounded sample of the labelled texts: the `EXAMPLES` of each class with the smallest hash of their id, fewer once their different terms are
more than `POSTINGS`, which bounds the index in bytes. Terms are lower-cased words without punctuation at their ends; every term of an example is in the index, and every
term of a text counts in its length, one that no example has too.

A term's weight is (1 + log tf) x idf x telling, vectors have length 1. Document frequencies are those among all documents (a term of no example counts as one of a single document).
`telling` says how well a term tells the classes of the examples apart: its log likelihood ratio over `FULL`, plus `LEAST`, at most 1. Without this factor a few
insults do not move the cosine of a long text: of 259 toxic held-out texts of the test data plain cosine finds 237 while flagging 644 of 2,241 clean ones, or 30 and none; with it,
all 259 and none.

The index keeps each term's postings in blocks of `BLOCK` examples with the largest weight of each block. A text asks for its
`NEIGHBOURS` nearest examples. Terms that one in `WIDE` examples has are kept side by side: one product gives a group of texts its scores by these alone, and so a bound
for the worst of the best. The maxima of the other terms' blocks then tell what each block can still gain; only blocks with an example that can get among the best are read.
The result is that of the full sum over all examples.

Votes: each neighbour counts with cosine^2 / (1 - cosine + `SOFT`), toxic ones for, others against, classes scaled from their shares of the sample to those of all
learnable labels; `DOUBT` votes at the labels' share of toxic texts are added. The share of votes becomes a probability by a logistic curve that is fitted to the examples, each judged by the others.
The evidence lists the nearest neighbours.

Defined results: null and empty texts, and texts without a known term, get what the curve makes of the labels' share; equal cosines go to the
smaller example id; repeated rows stay; a labelled id is one example, of several texts the one with the smallest hash; without examples of both classes every score is `BASE`; rows whose id is null are
scored, never learned from; columns besides id and text are not read.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialise, small_batches

EXAMPLES, POSTINGS, FULL, LEAST = 2000, 4_000_000, 200.0, 0.01
#: `WIDE_BYTES` bounds the rows kept side by side.
NEIGHBOURS, BLOCK, GROUP, WIDE, WIDE_BYTES = 15, 64, 64, 16, 32 << 20
BASE, DOUBT, SOFT = 0.05, 0.5, 0.05
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_"


def terms(text: str | None) -> Counter:
    """Counts of the terms."""
    found = Counter([x.strip(EDGE) for x in (text or "").lower().split()])
    found.pop("", None)
    return found




class Sent(NamedTuple):
    """What an index is sent as: postings by term with example places ascending, and what the votes need."""

    vocabulary: dict[str, int]
    idf: np.ndarray  # by term, its telling factor included
    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    unseen: float  # weight of a term that no example has
    base: float  # share of toxic texts among the labels
    pull: tuple[float, float]  # what a clean and a toxic example count, for the sample's shares of the classes
    curve: tuple[float, float]  # slope and shift of the logistic curve


class Index:
    """Postings with their blocks. Only `Sent` travels; blocks and the lists side by side are made from it where it arrives."""

    def __init__(self, sent: Sent):
        self.sent = sent
        self.vocabulary, self.idf, self.starts, self.places, self.weights, self.ids, self.toxic, self.unseen, self.base, self.pull, self.curve = sent
        sizes = np.diff(self.starts)
        term = np.repeat(np.arange(len(sizes)), sizes)
        block = self.places // BLOCK
        new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))  # where a term or a block begins
        self.block_starts = np.searchsorted(term[new], np.arange(len(sizes) + 1))  # by term: its first entry
        self.block_of, self.block_max = block[new], np.maximum.reduceat(self.weights, new)  # by entry
        self.entry_starts = np.append(new, len(term))  # by entry: its first posting
        # The lists that one in `WIDE` examples is in, the longest first: the weights of all examples side by side.
        many = np.flatnonzero(sizes * WIDE >= len(self.ids))
        many = np.sort(many[np.argsort(-sizes[many], kind="stable")][: WIDE_BYTES // (8 * len(self.ids))])
        self.wide, self.wide_row = np.zeros((len(many), len(self.ids))), np.full(len(sizes), -1, dtype=np.int32)
        self.wide_row[many] = np.arange(len(many))
        for row, a, b in zip(self.wide, self.starts[many], self.starts[many + 1]):
            row[self.places[a:b]] = self.weights[a:b]

    def __reduce__(self):
        return Index, (self.sent,)

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights; with the unknown ones, of length 1."""
        at = np.fromiter(map(self.vocabulary.get, counts, repeat(-1)), dtype=np.int64, count=len(counts))
        weights = (1 + np.log(np.fromiter(counts.values(), dtype=float, count=len(counts)))) * np.where(at < 0, self.unseen, self.idf[at])
        known = at >= 0
        return at[known], weights[known] / math.sqrt(float(weights @ weights) or 1.0)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> Iterator[list[tuple[float, int]]]:
        """For each vector the k examples of the largest cosine (over 0), as (cosine, place), nearest first."""
        for some in chunks(vectors, GROUP):
            common = np.zeros((len(some), len(self.wide)))
            for row, (found, weights) in zip(common, some):
                at = self.wide_row[found]
                row[at[at >= 0]] = weights[at >= 0]
            for (found, weights), scores in zip(some, common @ self.wide):
                rare = self.wide_row[found] < 0
                yield self._finish(found[rare], weights[rare], scores, k)

    def _finish(self, terms_: np.ndarray, own: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest, given the `scores` by the common terms and the other terms: a block of examples is read only
        if the maxima of the terms' blocks can lift one of its examples to the k-th best score so far."""
        least = np.partition(scores, -k)[-k] - 1e-12 if len(scores) > k else 0.0
        first, ends = self.block_starts[terms_], self.block_starts[terms_ + 1]
        entries, of_entry = spans(first, ends), np.repeat(own, ends - first)
        block = self.block_of[entries]
        reach = np.bincount(block, of_entry * self.block_max[entries], -(-len(scores) // BLOCK))
        open_ = np.flatnonzero(scores + np.repeat(reach, BLOCK)[: len(scores)] >= least)
        read = np.zeros(len(reach), dtype=bool)
        read[open_ // BLOCK] = True
        if 2 * np.count_nonzero(read) > len(read):  # most blocks: whole lists are read faster
            first, ends = self.starts[terms_], self.starts[terms_ + 1]
        else:
            entries, own = entries[read[block]], of_entry[read[block]]
            first, ends = self.entry_starts[entries], self.entry_starts[entries + 1]
        at = spans(first, ends)
        scores = scores + np.bincount(self.places[at], np.repeat(own, ends - first) * self.weights[at], len(scores))
        open_ = open_[scores[open_] >= max(least, 1e-300)]
        best = open_[np.lexsort((self.ids[open_], -np.round(scores[open_], 12)))][:k]
        return [(float(scores[p]), int(p)) for p in best]


def spans(first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges first..ends, one after the other."""
    sizes = ends - first
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def build(
    examples: list[tuple[int, int]], rows: list[tuple[int, dict[str, int]]], texts_of: dict[str, int], texts: int, told: dict[str, float] | None = None, base: float | None = None
) -> Index | None:
    """An index of examples (id, toxic), given the counts of their terms by example id, the number of all `texts` and of those that have each term,
    and how telling terms are (all alike if not given). None unless both classes are there and some term is."""
    examples = sorted(examples)
    toxic = np.array([t for _, t in examples], dtype=bool)
    if not texts_of or not len(examples) or toxic.all() or not toxic.any():
        return None
    vocabulary = {w: i for i, w in enumerate(sorted(texts_of))}
    least = LEAST if told else 1.0
    idf = np.array([(math.log((1 + texts) / (1 + texts_of[w])) + 1) * (told[w] if told else 1.0) for w in vocabulary])
    place_of = {i: p for p, (i, _) in enumerate(examples)}
    term, place, weight = [], [], []
    for at, words in sorted(((place_of[i], words) for i, words in rows), key=lambda x: x[0]):
        where = np.array([vocabulary[w] for w in words], dtype=np.int64)
        own = (1 + np.log(np.array(list(words.values()), dtype=float))) * idf[where]
        term.append(where)
        place.append(np.full(len(where), at, dtype=np.int64))
        weight.append(own / np.sqrt(np.sum(own * own)))
    term, place, weight = np.concatenate(term), np.concatenate(place), np.concatenate(weight)
    by_term = np.argsort(term, kind="stable")
    sizes = np.bincount(term, minlength=len(vocabulary))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    base = float(toxic.mean()) if base is None else base
    pull = ((1 - base) / float((~toxic).mean()), base / float(toxic.mean()))
    ids = np.array([i for i, _ in examples])
    unseen = (math.log((1 + texts) / 2) + 1) * least
    return Index(Sent(vocabulary, idf, starts, place[by_term].astype(np.int32), weight[by_term], ids, toxic, unseen, base, pull, (1.0, 0.0)))


def ratio(a: Column, n: int, b: Column, m: int) -> Column:
    """Log likelihood ratio of a of n against b of m texts with a term."""

    def part(count: Column, total: Column | int) -> Column:
        return F.when(count > 0, count * F.log(count / total)).otherwise(0.0)

    def entropy(yes: Column, total: int) -> Column:
        return part(yes, F.lit(total)) + part(F.lit(total) - yes, F.lit(total))

    return 2 * (entropy(a, n) + entropy(b, m) - entropy(a + b, n + m))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, per_class: int = EXAMPLES) -> Index | None:
    """The index of a bounded sample of the labelled rows for which `learnable` (a condition on `doc_id`) holds.

    Terms are counted on the cluster; the driver gets the examples' terms and counts, example by example, and a row for each of their different terms.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if learnable is not None:
        named = named.where(learnable)
    chosen = [named.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("one")
    rows = rows.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.toxic")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [terms(t) for t in batch["text"]]
            frame = {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "words": [list(f) for f in found], "counts": [list(f.values()) for f in found]}
            yield pd.DataFrame(frame)

    counted = rows.mapInPandas(count, "doc_id long, toxic int, words array<string>, counts array<int>")
    # Of at most `per_class` rows a class.
    in_turn = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    bounded = counted.withColumn("held", F.sum(F.size("words")).over(in_turn)).where(F.col("held") <= POSTINGS // 2).drop("held")
    counted = materialise(bounded, "examples")
    examples = [(r.doc_id, r.toxic) for r in counted.select("doc_id", "toxic").collect()]
    n_yes = sum(t for _, t in examples)
    n_no = len(examples) - n_yes
    if not n_yes or not n_no:
        return None
    pairs = counted.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    telling = F.least(F.lit(1.0), F.lit(LEAST) + ratio(F.col("a"), n_yes, F.col("n") - F.col("a"), n_no) / FULL)
    told = {sys.intern(r.word): r.told for r in pairs.select("word", telling.alias("told")).collect()}
    rows = [
        (r.doc_id, {sys.intern(w): n for w, n in zip(r.words, r.counts)}) for r in counted.select("doc_id", "words", "counts").toLocalIterator() if r.words
    ]
    texts, texts_of = frequencies(docs, list(told))
    share = named.agg(F.avg("toxic")).first()[0]
    index = build(examples, rows, texts_of, texts, told, share)
    return index and Index(index.sent._replace(curve=fitted(counted, index)))


def frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """The number of all rows, and of those that have each of the words. A task sends a row for each word at most."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {w: i for i, w in enumerate(sent.value)}
        texts, found = 0, np.zeros(len(place) + 1, dtype=np.int64)
        for batch in batches:
            texts += len(batch)
            for some in chunks(batch["text"].tolist(), GROUP):
                words = list(chain.from_iterable(map(terms, some)))
                found += np.bincount(np.fromiter(map(place.get, words, repeat(len(place))), dtype=np.int64, count=len(words)), minlength=len(found))
        here = np.flatnonzero(found[:-1])
        yield pd.DataFrame({"word": [None, *(sent.value[i] for i in here)], "n": [texts, *found[here].tolist()]})

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    by_word = {r.word: r.n for r in rows}
    return by_word.pop(None, 0), {w: by_word.get(w, 0) for w in words}


def fitted(counted: DataFrame, index: Index, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve from the examples' votes, each judged by the other examples; classes weigh as among the labels.

    The curve is held to (1, 0) by the weight of one example, so that separable classes give a steep, not an endless, slope.
    """
    sent = counted.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted_ = [dict(zip(w, n)) for w, n in zip(batch["words"], batch["counts"])]
            shares = [share for share, _ in votes(sent.value, counted_, batch["doc_id"].tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "vote": shares})

    spread = counted.repartition(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = spread.mapInPandas(judge, "doc_id long, toxic int, vote double").orderBy("doc_id").collect()
    sent.destroy()
    y = np.array([r.toxic for r in rows], dtype=float)
    x = np.array([logit(r.vote) for r in rows])
    weight = np.where(y > 0, index.pull[1], index.pull[0])
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        pull = weight * (y - p)
        gradient = np.array([(pull * x).sum() - (slope - 1), pull.sum() - shift])
        spread = weight * p * (1 - p)
        curvature = np.array([[(spread * x * x).sum() + 1, (spread * x).sum()], [(spread * x).sum(), spread.sum() + 1]])
        step = np.linalg.solve(curvature, gradient)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-300))
        slope, shift = slope + step[0], shift + step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(max(slope, 0.0)), float(shift)


def logit(share: float) -> float:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return math.log(share / (1 - share))


def votes(index: Index, counted: list[dict[str, int]], without: list[int] | None = None) -> Iterator[tuple[float, list[tuple[float, int]]]]:
    """For the terms of each text the toxic share of the votes, and the nearest examples; one example each may be left out."""
    found = index.nearest([index.vector(c) for c in counted], NEIGHBOURS + (without is not None))
    for near, own in zip(found, without or repeat(None)):
        near = [(c, p) for c, p in near if own is None or index.ids[p] != own][:NEIGHBOURS]
        toxic, total = DOUBT * index.base, DOUBT
        for cosine, place in near:
            bad = bool(index.toxic[place])
            weight = index.pull[bad] * cosine * cosine / (max(1 - cosine, 0.0) + SOFT)
            toxic, total = toxic + weight * bad, total + weight
        yield toxic / total, near


def judged(index: Index | None, texts: list[str | None]) -> list[tuple[float, str]]:
    """Probability and evidence of each text."""
    if index is None:
        return [(BASE, "")] * len(texts)
    slope, shift = index.curve
    out = []
    for share, near in votes(index, [terms(t) for t in texts]):
        told = ",".join(f"{index.ids[p]}:{'toxic' if index.toxic[p] else 'clean'}:{c:.4f}" for c, p in near[:3])
        out.append((1 / (1 + math.exp(-(slope * logit(share) + shift))), told))
    return out


def scores(docs: DataFrame, index: Index | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, `score`, `evidence` (the three nearest examples) for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(index)

    @F.pandas_udf("score double, evidence string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judged(sent.value, texts.tolist()), columns=["score", "evidence"])

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("v")).select("id", "v.*")

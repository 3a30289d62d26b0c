"""Importance resampling towards a target text by hashed word features.

A text's features are its runs of 1 to `most` consecutive words (`WORD`, A-Z in lower case), joined by one blank, repeats
counted. A feature's bucket is the unsigned CRC-32 of its UTF-8 bytes modulo `BUCKETS`. A bucket's gain is the logarithm of
its smoothed share in the target over that in the documents, in floored thousandths; a document's weight is the floored mean of its features'
gains. Its score adds Gumbel noise from a hash of its id, so the highest scores are a draw without replacement by weight, the same on
every run.

CRCs are computed for all new features of a batch at once: features of equal length are the rows of a two-dimensional uint8 array
whose columns update the CRCs of all rows one after the other, and the results are scattered back to the features. A feature longer than
`SPAN` bytes is cut into a head and rows of `SPAN` bytes each, whose CRCs are put together by the (linear) map that
`SPAN` zero bytes make. A worker remembers the buckets of `MEMORY` short features.

Counts are sums over all documents: a task sends at most one row for each bucket, the driver gets `BUCKETS` rows. Scores are written
once with a number for each row. As scores are whole thousandths, a histogram of them gives the score at which the draw ends; only rows from there
on are ranked, dealt out by ranges of score, id and row number, so neither many equal scores nor many equal rows meet in one task.

Defined results: null and empty texts have no features and weight 0; documents under `least` words are scored but not drawn; equal scores go to
the smaller id, null ids last, equal rows in either order; a null id hashes as an empty one; repeated rows are documents of their own; without
target texts, or without documents, gains are still defined by the smoothing; an empty table gives an empty result; columns besides id and text are
only carried when asked for.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, running, small_batches

BUCKETS, MOST, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SPAN, MEMORY, KEEP, SLICE = 64, 400_000, 64, 1 << 22
#: In UTF-8 every byte of a character beyond ASCII lies above \x7F, so the class of characters is a class of bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


TABLE = _byte_table()


def advance(state: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """CRC states of all rows after their bytes, column by column."""
    for column in rows.T:
        state = TABLE[(state ^ column) & 0xFF] ^ (state >> 8)
    return state


def _span_tables() -> np.ndarray:
    """What `SPAN` zero bytes make of a state, by each of its four bytes."""
    states = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    return advance(states, np.zeros((1024, SPAN), dtype=np.uint8)).reshape(4, 256)


SPANS = _span_tables()


def crcs(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature, by one matrix for each length."""
    sizes = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    out = np.empty(len(features), dtype=np.uint32)
    short = np.where(sizes <= SPAN, sizes, -1)
    for size in np.unique(short[short >= 0]):
        at = np.flatnonzero(short == size)
        rows = np.frombuffer(b"".join([features[i] for i in at]), dtype=np.uint8).reshape(len(at), size)
        out[at] = advance(np.full(len(at), 0xFFFFFFFF, dtype=np.uint32), rows)
    for i in np.flatnonzero(short < 0):
        out[i] = _long(features[i])
    return out ^ np.uint32(0xFFFFFFFF)


def _long(feature: bytes) -> int:
    head = len(feature) % SPAN
    state = int(advance(np.full(1, 0xFFFFFFFF, dtype=np.uint32), np.frombuffer(feature[:head], dtype=np.uint8).reshape(1, head))[0])
    rows = np.frombuffer(feature, dtype=np.uint8, offset=head).reshape(-1, SPAN)
    a, b, c, d = SPANS.tolist()
    for own in advance(np.zeros(len(rows), dtype=np.uint32), rows).tolist():
        state = a[state & 0xFF] ^ b[state >> 8 & 0xFF] ^ c[state >> 16 & 0xFF] ^ d[state >> 24] ^ own
    return state


class Hasher:
    """Buckets of features, remembered between batches."""

    def __init__(self, buckets: int = BUCKETS, most: int = MOST):
        self.buckets, self.most = buckets, most
        self.known: dict[bytes, int] = {}

    def of(self, features: list[bytes]) -> np.ndarray:
        known = self.known
        new = list(set(features) - known.keys())
        if new:
            known.update(zip(new, (crcs(new) % np.uint32(self.buckets)).tolist()))
        out = np.fromiter(map(known.__getitem__, features), dtype=np.int64, count=len(features))
        if len(known) > MEMORY:
            known.clear()
        elif new and max(map(len, new)) > KEEP:
            for feature in new:
                if len(feature) > KEEP:
                    del known[feature]
        return out

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(place of the text, its words, buckets of its features), for a long text several times."""
        near: list[tuple[int, list[bytes]]] = []
        for place, text in enumerate(texts):
            raw = (text or "").encode(errors="surrogatepass").lower()  # of bytes, lower() changes A-Z alone
            if len(raw) <= SLICE:
                near.append((place, WORD.findall(raw)))
            else:
                yield from self._far(place, raw)
        features = [self._runs(words, 0) for _, words in near]
        buckets = self.of([f for some in features for f in some]) if features else np.zeros(0, dtype=np.int64)
        ends = np.cumsum([len(f) for f in features]) if features else []
        for (place, words), some, end in zip(near, features, ends):
            yield place, len(words), buckets[end - len(some) : end]

    def _far(self, place: int, raw: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
        before: list[bytes] = []
        at = 0
        while at < len(raw):
            cut = GAP.search(raw, at + SLICE)
            end = cut.start() if cut else len(raw)
            words = WORD.findall(raw, at, end)
            yield place, len(words), self.of(self._runs([*before, *words], len(before)))
            before = [*before, *words][len(before) + len(words) - self.most + 1 :] if self.most > 1 else []
            at = end

    def _runs(self, words: list[bytes], old: int) -> list[bytes]:
        """Runs of 1 to `most` words that do not lie in the first `old` words."""
        found = words[old:]
        for n in range(2, self.most + 1):
            found = found + [b" ".join(words[i : i + n]) for i in range(max(0, old - n + 1), len(words) - n + 1)]
        return found


def counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most: int = MOST) -> list[int]:
    """Features by bucket over all texts. A task sends a row for each bucket at most."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, found = Hasher(buckets, most), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, own in hasher.texts(batch["text"].tolist()):
                found += np.bincount(own, minlength=buckets)
        some = np.flatnonzero(found)
        yield pd.DataFrame({"bucket": some, "n": found[some]})

    sent = texts.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInPandas(run, "bucket long, n long")
    out = [0] * buckets
    for r in sent.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(of_docs: list[int], of_target: list[int]) -> list[int]:
    """Floored thousandths of the log ratio of the smoothed shares, by bucket."""
    size, s_all, t_all = len(of_docs), sum(of_docs), sum(of_target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(of_docs, of_target)]


def noise(doc_id: object, seed: int = SEED) -> int:
    """Gumbel noise in floored thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", most: int = MOST, seed: int = SEED) -> Column:
    """A struct column for `docs`: `n_words`, `n_features`, `weight`, `score`."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gain, dtype=np.int64))

    @F.pandas_udf("n_words long, n_features long, weight long, score long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        gain_of = sent.value
        hasher = Hasher(len(gain_of), most)
        for ids, texts in batches:
            words, features, sums = np.zeros((3, len(texts)), dtype=np.int64)
            for place, n, own in hasher.texts(texts.tolist()):
                words[place] += n
                features[place] += len(own)
                sums[place] += gain_of[own].sum()
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            score = weight + np.fromiter((noise(i, seed) for i in ids), dtype=np.int64, count=len(ids))
            yield pd.DataFrame({"n_words": words, "n_features": features, "weight": weight, "score": score})

    return run(F.col(id_col).cast("string"), F.col(text_col))


def ranked(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *, carry: list[str] | None = None,
    percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """`id`, `n_words`, `n_features`, `weight`, `score`, `rank` (null: not drawn) for each row, and the columns `carry` in a struct `row`."""
    gain = gains(counts(docs, text_col, buckets, most), counts(target, target_col, buckets, most))
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    scored = docs.select(F.col(id_col).alias("id"), scores(docs, gain, id_col, text_col, most, seed).alias("v"), *kept)
    number, *_ = fresh("number")
    own = ["id", "n_words", "n_features", "weight", "score", *(["row"] if carry else [])]
    scored = materialise(scored.select("id", "v.*", *own[5:]).withColumn(number, F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least
    # A row for each whole score, of which there are as many as the gains and the noise span, whatever the table's size.
    steps = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    total = steps.agg(F.sum("n")).first()[0] or 0
    drawn = percent * total // 100
    upto = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = steps.withColumn("upto", upto).where(F.col("upto") >= drawn).agg(F.max("score")).first()[0] if drawn else None
    if last is None:
        return scored.select(*own, F.lit(None).cast("long").alias("rank"))
    near = able & (F.col("score") >= last)
    order = [F.desc("score"), F.col("id").asc_nulls_last(), F.col(number)]
    best = running(scored.where(near), order, {"rank": F.lit(1)}, "ranks")
    best = best.select(*own, F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long").alias("rank"))
    return scored.where(~near).select(*own, F.lit(None).cast("long").alias("rank")).unionByName(best)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The drawn rows of `docs`, with all their columns."""
    found = ranked(docs, target, id_col, text_col, carry=docs.columns, **kw)
    return found.where("rank IS NOT NULL").select("row.*")

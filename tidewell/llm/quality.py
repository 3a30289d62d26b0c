"""Quality rules: a linear-chain conditional random field labels each line of a text as content or boilerplate.

Base rules come first: too few words, or too many words in repeated windows of three. For the other texts Viterbi
decoding marks the lines, and the share of characters in content lines decides.

The field has two labels, a weight for each feature and label, and a weight for each pair of neighbouring labels. It is
trained here on a bounded sample (`SAMPLE_DOCS` labelled documents of each quality, those with the smallest hash of
their id; of those, texts of at most `SAMPLE_LINES` lines). Only documents are labelled, not lines, so training alternates:
lines of good documents are content; lines of poor documents start as boilerplate and take the field's own
decoding afterwards, with at least the most suspicious line kept as boilerplate. Without labels of both kinds `PRIOR` weights serve.
Everything else reads whole texts, and no step depends on how many there are. Scoring is one pass without a shuffle.

Defined results: a null or empty text has no words and fails the base rules; line ends are \\n; lines without a word
belong to the line before and are content if they come first; repeated rows stay; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches, table

SAMPLE_DOCS, SAMPLE_LINES = 600, 500
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A text stays if at least this share of its characters lies in content lines.
LEAST_SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1
SYMBOLS = "#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
FEATURES = ("bias", "symbols", "many_symbols", "bars", "capitals", "shouting", "echo", "heavy_echo", "seen", "short", "no_stop", "digits")


class Field(NamedTuple):
    """Weights: `emit` [feature, label], `move` [label, label]."""

    emit: np.ndarray
    move: np.ndarray


def prior() -> Field:
    """Weights before any training: suspicious features speak for boilerplate, neighbours tend to agree."""
    emit = np.zeros((len(FEATURES), 2))
    emit[:, BOILERPLATE] = [-2.0, 1.0, 3.0, 2.0, 1.0, 3.0, 1.0, 3.0, 1.0, 0.2, 0.2, 0.5]
    return Field(emit, np.array([[0.5, -0.5], [-0.5, 0.5]]))


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeated(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    kinds = len(numbers)
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 20:  # three numbers would not fit one word
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * kinds + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


def base(text: str) -> Base:
    words = text.encode().split()  # bytes split at ASCII white space only
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            again += line in seen
            seen.add(line)
    blanks = sum(text.count(c) for c in BLANKS)
    return Base(len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), again, repeated(words))


def lines_of(text: str) -> tuple[list[str], list[int]]:
    """Lines with a word, and the characters each stands for (its own and those of blank lines after it)."""
    lines: list[str] = []
    sizes: list[int] = []
    for line in text.split("\n"):
        if line.strip(BLANKS) or not lines:
            lines.append(line)
            sizes.append(len(line))
        else:
            sizes[-1] += len(line)
    return lines, sizes


def features(lines: list[str]) -> np.ndarray:
    """[line, feature] of a text's lines."""
    out = np.zeros((len(lines), len(FEATURES)))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        size, count = max(len(line), 1), max(len(words), 1)
        symbols = sum(line.count(c) for c in SYMBOLS)
        bars = line.count("|")
        raw = line.encode()
        upper = (len(raw) - len(raw.translate(None, CAPITALS))) / size
        echo = sum(map(eq, words, words[1:])) / count
        digits = (len(raw) - len(raw.translate(None, b"0123456789"))) / size
        out[i] = (
            1.0, min(symbols / count, 2.0), symbols > 0.2 * count, bars > 0.2 * count, upper > 0.3, "!!" in line,
            echo, echo > 0.3, line in seen, count < 4, line.rstrip()[-1:] not in ".!?\"'", min(digits * 2, 1.0),
        )
        seen.add(line)
    return out


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label sequence for scores [line, label]; ties go to content."""
    best, back = scores[0], np.zeros(scores.shape, dtype=np.int64)
    for i in range(1, len(scores)):
        ways = best[:, None] + move
        back[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[i]
    path = np.empty(len(scores), dtype=np.int64)
    path[-1] = best.argmax()
    for i in range(len(scores) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def decode(field: Field, lines: list[str]) -> np.ndarray:
    return viterbi(features(lines) @ field.emit, field.move)


def content_share(field: Field, text: str) -> float:
    lines, sizes = lines_of(text)
    total = sum(sizes)
    marked = decode(field, lines)
    return float(np.dot(marked == CONTENT, sizes) / total) if total else 0.0


def _likelihood(field: Field, texts: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood by forward and backward sums."""
    emit, move = np.zeros_like(field.emit), np.zeros_like(field.move)
    for x, y in zip(texts, labels):
        scores, n = x @ field.emit, len(x)
        ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
        ahead[0] = scores[0]
        for i in range(1, n):
            ahead[i] = np.logaddexp(ahead[i - 1, 0] + field.move[0], ahead[i - 1, 1] + field.move[1]) + scores[i]
        for i in range(n - 2, -1, -1):
            step = behind[i + 1] + scores[i + 1]
            behind[i] = np.logaddexp(field.move[:, 0] + step[0], field.move[:, 1] + step[1])
        whole = np.logaddexp(*ahead[-1])
        seen = np.eye(2)[y]
        emit += x.T @ (seen - np.exp(ahead + behind - whole))
        if n > 1:
            pairs = ahead[:-1, :, None] + field.move + (scores[1:] + behind[1:])[:, None, :]
            move += seen[:-1].T @ seen[1:] - np.exp(pairs - whole).sum(axis=0)
    return emit, move


def fit(texts: list[np.ndarray], good: list[bool], rounds: int = 2, steps: int = 15, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Train on texts' line features and whether each text is good."""
    field = prior()
    count = sum(map(len, texts))
    for turn in range(rounds):
        labels = []
        for x, fine in zip(texts, good):
            scores = x @ field.emit
            y = np.zeros(len(x), dtype=np.int64) if fine else viterbi(scores, field.move) if turn else np.ones(len(x), dtype=np.int64)
            if not fine:
                y[np.argmax(scores[:, BOILERPLATE] - scores[:, CONTENT])] = BOILERPLATE
            labels.append(y)
        field = prior()
        size_e, size_m = np.full_like(field.emit, 1e-8), np.full_like(field.move, 1e-8)
        for _ in range(steps):
            emit, move = _likelihood(field, texts, labels)
            emit, move = emit / count - ridge * field.emit, move / count - ridge * field.move
            size_e, size_m = size_e + emit**2, size_m + move**2
            field = Field(field.emit + rate * emit / np.sqrt(size_e), field.move + rate * move / np.sqrt(size_m))
    return field


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> Field:
    """Fit the field on a bounded sample of labelled documents; only line features come to the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    named = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = [named.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    # One text for each id, the same on every run, however often the id is there.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "quality")).alias("one")).select("doc_id", "one.text", "one.quality")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, q, lines_of(t)[0]) for i, q, t in zip(batch["doc_id"], batch["quality"], batch["text"])]
            found = [(i, q, features(lines).astype("<f4").tobytes()) for i, q, lines in found if len(lines) <= SAMPLE_LINES]
            yield pd.DataFrame(found, columns=["doc_id", "quality", "x"])

    got = sorted(rows.mapInPandas(measure, "doc_id long, quality int, x binary").collect())
    texts = [np.frombuffer(r.x, dtype="<f4").reshape(-1, len(FEATURES)).astype(float) for r in got]
    good = [r.quality == 1 for r in got]
    return fit(texts, good) if any(good) and not all(good) else prior()


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(field: Field, text: str | None) -> tuple:
    rules = base(text or "")
    share = content_share(field, text) if text else 0.0
    return (*rules, rules.failed, not rules.failed and share >= LEAST_SHARE, share)


def judged_by(field: Field, text_col: str = "text") -> Column:
    """A struct of `SCORED`."""

    @F.pandas_udf(SCORED)
    def run(texts: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in SCORED.split(", ")]
        return pd.DataFrame([judge(field, t) for t in texts], columns=names)

    return run(F.col(text_col))


def verdicts(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id` and the fields of `SCORED` for each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), judged_by(field, text_col).alias("judged")).select("id", "judged.*")


def retain(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the rules and the content share keep."""
    small_batches(docs.sparkSession)
    (judged,) = fresh("judged")
    return docs.withColumn(judged, judged_by(field, text_col)).where(f"{judged}.kept").select(docs.columns)


def train_from(spark: SparkSession, sf_dir: str) -> Field:
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence are combined for each page and language:
 - text: a multinomial model of character trigrams, trained here on a bounded sample of documents of known language (`SAMPLE_DOCS` a
   language, those with the smallest hash of their id; the `GRAMS` most frequent trigrams of each). Letters depend on each other, so a text counts as at most `EFFECTIVE` trigrams;
 - declared markup language: P(declared | language), from all pages' sums of text posteriors by declaration;
 - address suffix: P(suffix | language), from all pages' sums by suffix;
 - host prior: each host's sums, without the page's own, smoothed towards its domain's, those towards all pages' (`PULL` pseudo-pages a level).
The sums are grouped aggregations with partial sums before the shuffle; tables by suffix, domain and host are joined back. Only what the number of
languages bounds comes to the driver: the `LANGUAGES` that most documents have are learnt. A host that is a number has neither domain nor suffix.

Defined results: a page without text, address or declaration lacks that evidence only; a declaration of an unknown language counts as its own
value; ties go to the alphabetically first language; repeated rows stay; an empty table gives an empty result; without training texts
languages are unknown and the result has null languages.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

SAMPLE_DOCS, GRAMS, LANGUAGES = 300, 3000, 256
#: Labels of kinds of registrants below a country's suffix.
KINDS = ("ac", "co", "com", "edu", "gov", "mil", "net", "or", "org")
EFFECTIVE, PULL, EVEN = 60, 5.0, 1.0
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)", re.I | re.S)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", re.I)


def visible(page: str) -> str:
    """A page's text without markup, scripts and comments."""
    return entities.unescape(MARKUP.sub(" ", page))


def trigrams(text: str) -> np.ndarray:
    """Codes of a text's trigrams of lower-case characters; white space is one blank."""
    marks = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    return (marks[:-2] << 42) | (marks[1:-1] << 21) | marks[2:] if len(marks) > 2 else np.zeros(0, dtype=np.int64)


class Model(NamedTuple):
    """Sorted trigram codes and their log probabilities [trigram, language]."""

    languages: list[str]
    codes: np.ndarray
    logs: np.ndarray

    def likelihood(self, text: str) -> np.ndarray:
        """Log likelihoods of a text by language; a long text counts as `EFFECTIVE` trigrams."""
        found = trigrams(text)
        if not len(found) or not len(self.codes):
            return np.zeros(len(self.languages))
        at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        known = at[self.codes[at] == found]
        if not len(known):
            return np.zeros(len(self.languages))
        return self.logs[known].sum(axis=0) * min(1.0, EFFECTIVE / len(known))


def train(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    small_batches(docs.sparkSession)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    few = usable.select("lang", "doc_id").join(F.broadcast(common), "lang").distinct()
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "doc_id")
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    # One text for each id, the same on every run, however often the id is there.
    rows = rows.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")).select("lang", "one.text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                codes, n = np.unique(trigrams(text), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    counted = rows.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    kept = counted.withColumn("rank", top).where(F.col("rank") <= GRAMS).select("lang", "code", "n").collect()
    languages = sorted({r.lang for r in kept})
    codes = np.array(sorted({r.code for r in kept}), dtype=np.int64)
    counts = np.full((len(codes), len(languages)), 0.5)
    for r in kept:
        counts[np.searchsorted(codes, r.code), languages.index(r.lang)] += r.n
    return Model(languages, codes, np.log(counts / counts.sum(axis=0)))


def softmax(logs: np.ndarray) -> np.ndarray:
    out = np.exp(logs - logs.max())
    return out / out.sum()


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user, port and closing point; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    return F.when(F.length(host) > 0, F.rtrim(host, F.lit(".")))


def _number(host: Column) -> Column:
    """Whether a host is an address of numbers, which has neither domain nor suffix."""
    return host.rlike(r"^(\[.*|[0-9]+(\.[0-9]+){3})$")


def domain_of(host: Column) -> Column:
    """The last two labels of a host, the last three where the second last stands for a kind of registrant (`KINDS`) below a country's two letters; else the host."""
    domain = F.regexp_extract(host, rf"((?:[^.]+\.(?:{'|'.join(KINDS)})\.[a-z]{{2}})|[^.]+\.[^.]+)$", 1)
    return F.when(_number(host) | (domain == ""), host).otherwise(domain)


def suffix_of(host: Column) -> Column:
    return F.when(~_number(host), F.element_at(F.split(host, r"\."), -1))


def measured(pages: DataFrame, model: Model, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """`page`, `host`, `domain`, `suffix`, `declared`, `logs`, `p`: the evidence of each page and its posterior by text alone."""
    small_batches(pages.sparkSession)
    host = host_of(F.col(url_col))
    rows = pages.select(
        F.col(id_col).alias("page"), host.alias("host"), domain_of(host).alias("domain"), suffix_of(host).alias("suffix"), F.col(html_col).alias("html"),
    )

    @F.pandas_udf("declared string, logs array<double>, p array<double>")
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            text = text or ""
            said = DECLARED.search(text)
            logs = model.likelihood(visible(text))
            declared = None if said is None else said[1].lower() if said[1].lower() in model.languages else "other"
            out.append((declared, logs, softmax(logs)))
        return pd.DataFrame(out, columns=["declared", "logs", "p"])

    return rows.withColumn("m", read("html")).select("page", "host", "domain", "suffix", "m.*")


def fuse(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`page`, `lang`, `probability`, `text_lang`, `declared`, `host` for each row."""
    if not model.languages:
        return pages.select(
            F.col(id_col).alias("page"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"),
        )
    n = len(model.languages)
    rows = materialise(measured(pages, model, id_col, url_col, html_col), "evidence")
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]

    def by(key: str) -> DataFrame:
        grouped = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*sums, F.count(F.lit(1)).alias("n"))
        return grouped.select(F.col(key).alias(f"{key}_of"), F.array(*[f"s{i}" for i in range(n)]).alias(f"{key}_sums"), F.col("n").alias(f"{key}_n"))

    totals = rows.agg(*sums).first()
    total = [float(x or 0.0) for x in totals]
    whole = sum(total) or 1.0
    overall = [(t + EVEN) / (whole + EVEN * n) for t in total]

    # P(declared | language): a small table, by language and declaration.
    said = {r.declared_of: r.declared_sums for r in by("declared").collect()}
    declared_logs = {d: [math.log((s + EVEN) / (sum(x[i] for x in said.values()) + EVEN * len(said))) for i, s in enumerate(v)] for d, v in said.items()}
    none = F.array(*[F.lit(0.0)] * n)
    declared = none
    for value, logs in declared_logs.items():
        declared = F.when(F.col("declared") == value, F.array(*[F.lit(x) for x in logs])).otherwise(declared)

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), none)

    def share(sums_: Column, count: Column, base: Column) -> Column:
        return F.zip_with(sums_, base, lambda s, b: (F.greatest(s, F.lit(0.0)) + PULL * b) / (count + PULL))

    rows = rows.join(by("suffix"), F.col("suffix") == F.col("suffix_of"), "left").join(by("domain"), F.col("domain") == F.col("domain_of"), "left")
    rows = rows.join(by("host"), F.col("host") == F.col("host_of"), "left")
    base = F.array(*[F.lit(x) for x in overall])
    mass = F.array(*[F.lit(t + EVEN) for t in total])
    suffix_n = F.coalesce("suffix_n", F.lit(0))
    # A suffix's likelihood relative to its overall frequency, smoothed towards no preference.
    suffix = F.zip_with(known("suffix_sums"), mass, lambda s, m: F.log((s + PULL * suffix_n / whole) / (m + PULL) / F.greatest(suffix_n / whole, F.lit(1e-12))))
    suffix = F.when(suffix_n > 0, suffix).otherwise(none)

    def without_own(name: str) -> Column:
        own = F.when(F.col(f"{name}_n") > 0, F.col("p")).otherwise(none)
        return F.zip_with(known(f"{name}_sums"), own, lambda s, p: s - p)

    def others(name: str) -> Column:
        return F.greatest(F.coalesce(f"{name}_n", F.lit(0)) - 1, F.lit(0))

    rows = rows.withColumns({"declared_logs": declared, "suffix_logs": suffix, "domain_share": share(without_own("domain"), others("domain"), base)})
    rows = rows.withColumn("prior", share(without_own("host"), others("host"), F.col("domain_share")))
    joint = F.zip_with(F.zip_with("logs", "declared_logs", lambda a, b: a + b), F.zip_with("suffix_logs", "prior", lambda a, b: a + F.log(b)), lambda a, b: a + b)
    rows = rows.withColumn("joint", joint).withColumn("most", F.array_max("joint"))
    names = F.array(*[F.lit(x) for x in model.languages])
    odds = F.aggregate(F.transform("joint", lambda x: F.exp(x - F.col("most"))), F.lit(0.0), lambda s, x: s + x)
    return rows.select(
        "page", F.element_at(names, F.array_position("joint", F.col("most")).cast("int")).alias("lang"), (1 / odds).alias("probability"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"), "declared", "host",
    )

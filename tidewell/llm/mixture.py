"""Mixing sources to target weights by nested hash thresholds.

Every document has a hash of its id. A source whose target is t words out of s takes all documents floor(t / s)
times and, once more, those whose hash lies below a threshold: the thresholds of the copies are nested.
The threshold is found from histograms: words are summed by source and hash bucket, the bucket in which
the budget runs out is refined with the next bits, and only its documents are summed again. Nothing is
sorted and no group of documents meets in one task; a histogram has at most 2^`LEVEL_BITS` rows a source.

Targets: sources in code-point order, null last, have the weights in turn and share `share` of all words.
A source's target stops at `most` times its words; what it leaves is shared by the others by weight. That is a water level,
found from running sums over the sources in the order in which they fill up.

Defined results: a null text has size 0; a null source is a source; rows with the same id share a hash and are taken
alike; a source without words has target 0 and takes nothing (its documents have no words to take); an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, running

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: A hash has LEVELS x LEVEL_BITS bits.
LEVELS, LEVEL_BITS = 4, 15
WORD = r"[^\x20\x09-\x0D]++"


def words_in(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(id_col: str) -> Column:
    """60 bits of the MD5 of the id as text (a null id: of an empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`source`, `source_size`, `target` from `source`, `source_size` (one row for each source)."""
    ranked = running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "ranks")
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("fills_at", most * F.col("source_size") / F.col("weight"))
    order = [F.col("fills_at"), F.col("source").asc_nulls_last()]
    level = running(weighed, order, {"full": F.col("source_size"), "used": F.col("weight")}, "levels")
    total, heavy = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    if not heavy:
        return sources.select("source", "source_size", F.lit(0.0).alias("target"))
    left = (F.lit(share) * total - most * F.col("full")) / (F.lit(heavy) - F.col("used"))
    level = level.withColumn("level", left)
    water = level.where("level <= fills_at").agg(F.min_by("level", F.struct("fills_at", "used"))).first()[0]
    cap = (most * F.col("source_size")).cast("double")
    target = cap if water is None else F.least(F.lit(float(water)) * F.col("weight"), cap)
    return weighed.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """`source`, `source_size`, `target`, `copies`, `below`: documents are taken `copies` times, and once more if hash < `below`.

    `sized` has `source`, `size`, `hash`; it is read once for each level.
    """
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    start = goals.withColumn("copies", ratio)
    at = materialise(
        start.withColumns(
            {"budget": F.col("target") - F.col("copies") * F.col("source_size"), "prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long")}
        ),
        "budgets",
    )
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = at.select(F.col("source").alias("of"), "prefix", "before", "budget").where("budget > 0")
        rows = sized.withColumn("part", F.shiftrightunsigned("hash", shift))
        near = rows.join(inside, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("part", LEVEL_BITS) == F.col("prefix")))
        sums = near.groupBy("of", "part").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("budget").alias("budget"))
        crossed = _crossing(sums).select(F.col("of").alias("of"), F.col("part").alias("new_prefix"), F.col("upto").alias("new_before"), F.col("size").alias("last_size"))
        at = at.select("source", "source_size", "target", "copies", "budget", "prefix", "before").join(
            crossed, F.col("source").eqNullSafe(F.col("of")), "left"
        )
        # A bucket that holds no boundary (the budget is 0) keeps its prefix at the next level's first bucket.
        at = at.select(
            "source", "source_size", "target", "copies", "budget",
            F.coalesce("new_prefix", F.shiftleft("prefix", LEVEL_BITS)).alias("prefix"),
            F.coalesce("new_before", "before").alias("before"), F.coalesce("last_size", F.lit(0)).alias("last_size"),
        )
        at = materialise(at, f"level{level}")
    over, under = F.col("before") + F.col("last_size") - F.col("budget"), F.col("budget") - F.col("before")
    takes_last = (F.col("budget") > 0) & (over < under)
    below = F.when(F.col("budget") > 0, F.col("prefix") + takes_last.cast("long")).otherwise(F.lit(0).cast("long"))
    return at.select("source", "source_size", "target", "copies", below.alias("below"))


def _crossing(sums: DataFrame) -> DataFrame:
    """For each source the bucket in which its budget runs out, with the words before it (`upto`)."""
    from pyspark.sql import Window

    order = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = sums.withColumn("total", F.sum("size").over(order) + F.col("before")).withColumn("upto", F.col("total") - F.col("size"))
    crossed = ran.where((F.col("upto") <= F.col("budget")) & (F.col("budget") < F.col("total")))
    return crossed.select("of", "part", "upto", "size")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Sized rows (`id`, `source`, `size`, `hash`) and the thresholds of the sources."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), hash_of(id_col).alias("hash"))
    sized = materialise(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, thresholds(sized, targets(sources, weights, share))


def with_copies(rows: DataFrame, limits: DataFrame, source: str, hashed: Column) -> tuple[DataFrame, dict[str, Column]]:
    """Rows joined with the limits of their sources, and the columns `copies`, `source_size`, `target`."""
    names = dict(zip(("source", "source_size", "target", "copies", "below", "hash"), fresh("source", "size", "target", "copies", "below", "hash")))
    limits = limits.select(*[F.col(c).alias(names[c]) for c in ("source", "source_size", "target", "copies", "below")])
    joined = rows.withColumn(names["hash"], hashed).join(limits, F.col(source).eqNullSafe(F.col(names["source"])))
    copies = F.col(names["copies"]) + (F.col(names["hash"]) < F.col(names["below"])).cast("long")
    return joined, {"copies": copies, "source_size": F.col(names["source_size"]), "target": F.col(names["target"])}


def plan(docs: DataFrame, **kw) -> DataFrame:
    """`id`, `size`, `source_size`, `target`, `taken` for each row."""
    sized, limits = mix(docs, **kw)
    found, of = with_copies(sized, limits, "source", F.col("hash"))
    return found.select("id", "size", of["source_size"].alias("source_size"), of["target"].alias("target"), (F.col("size") * of["copies"]).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    _, limits = mix(docs, id_col, text_col, source_col, **kw)
    found, of = with_copies(docs, limits, source_col, hash_of(id_col))
    (copy,) = fresh("copy")
    taken = found.where(of["copies"] > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), of["copies"])))
    return taken.select(*docs.columns)

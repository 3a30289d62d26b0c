"""URL filtering by pattern rules that are indexed by their rarest literal token; SQL functions only.

A rule is a line of text. `||` before a host stands for that host and all its subdomains, and what follows, up to the first `/`, is the host, the rest
the beginning of the path (a site rule). Any other line is a pattern: `*` is any run of characters, `^` one that is no ASCII letter or digit nor one of `_-.%`, or
the url's end; `|` at an end ties the pattern to the url's start or end. `@@` before a line allows what it matches; other lines block.

Tokens are runs of ASCII letters and digits, A-Z in lower case. A literal token of a rule is one that other literal characters or ties bound on both sides:
a url that the rule matches holds it as a whole token. Each rule is indexed by that of its literal tokens which fewest urls hold (a rule without any, by the
empty token, which every url has). A url's tokens fetch the rules indexed by them, and regular expressions run for these alone.

Of the site rules that fit, the longest wins; if none does, an allowing pattern wins over blocking ones, then the longest pattern; otherwise the url is allowed.
Equal lengths go to the smaller text; of the same site rule allowed and blocked, the allowing one wins.

At scale: distinct urls are judged, so a url that a third of all rows have costs one; only urls that some rule matches go back to the rows, by a left join whose large side
adaptive execution may split. Token frequencies are counted for the rules' tokens only. The index is written once, so Spark knows its size: it broadcasts a
small one and shuffles a large one; no size of it is assumed.

Defined results: a null url, or one without `://`, has empty host and path, so no site rule fits it; patterns need a url; host labels are compared with A-Z in lower case, paths as they
are; a url ends where its text does, however long; repeated rows stay; an empty table gives an empty result, no rules allow everything; columns besides id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise

#: The rules that apply where a caller names no others: pages without text of their own.
PATTERNS = [
    "/wp-login.", "/cgi-bin/", "/cart/", "/checkout/", "^sessionid=", "^utm_source=feed^", "/search?", "/tag/*/page/", "*.exe|", "*.zip|", "@@/robots.txt|", "@@/sitemap*.xml|",
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit("([a-z0-9]+)"), 1)


def quoted(text: Column) -> Column:
    """A regular expression for the text itself."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}])", r"\\$1")


def compiled(spark: SparkSession, lines: list[str] | DataFrame) -> DataFrame:
    """`rule` (without its marks for site rules), `verdict`, `site`, `regex`, `literals` for each distinct line (a DataFrame has them as `line`).

    Site rules run on a point, the host and the path; patterns on the url.
    """
    if not isinstance(lines, DataFrame):
        lines = spark.range(1).select(F.explode(F.array(*map(F.lit, lines)).cast("array<string>")).alias("line"))
    rows = lines.select("line")
    line = F.trim("line")
    rows = rows.select(line.alias("line")).where(F.length("line") > 0).distinct()
    body = F.regexp_replace("line", "^@@", "")
    rows = rows.select(
        "line", F.when(F.col("line").startswith("@@"), "allow").otherwise("block").alias("verdict"), body.startswith("||").alias("site"),
        F.regexp_replace(body, r"^\|\|", "").alias("body"),
    )
    host = lowered(F.regexp_extract("body", "(?s)^([^/]*)", 1))
    path = F.regexp_extract("body", "(?s)^[^/]*(.*)$", 1)
    rule = F.when(F.col("site"), F.concat(host, path)).otherwise(F.col("line"))
    fits_host = F.concat(F.lit(r"(?s)^[^/]*\."), quoted(host), F.when(path == "", r"(?:/|\z)").otherwise(quoted(path)))
    inner = F.regexp_replace(F.regexp_replace("body", r"^\|", ""), r"\|$", "")
    found = F.regexp_replace(F.regexp_replace(quoted(inner), r"\\\*", ".*"), r"\\\^", r"(?:[^A-Za-z0-9_.%-]|\\z)")
    tied = [F.when(F.col("body").startswith("|"), "^").otherwise(""), F.when(F.col("body").endswith("|"), r"\z").otherwise("")]
    matches = F.concat(F.lit("(?s)"), tied[0], found, tied[1])
    # The point stands for what a host begins after; a tie of a pattern is a character of its own already.
    bounded = F.when(F.col("site"), F.concat(F.lit("."), "body", F.when(path == "", "/").otherwise(""))).otherwise(F.col("body"))
    literals = F.regexp_extract_all(lowered(bounded), F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), 1)
    return rows.select(rule.alias("rule"), "verdict", "site", F.when(F.col("site"), fits_host).otherwise(matches).alias("regex"), F.array_distinct(literals).alias("literals"))


def index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules by their rarest literal token (`token`); `urls` has distinct `url`s."""
    literal = rules.select(F.explode("literals").alias("token")).distinct()
    held = urls.select(F.explode(F.array_distinct(tokens(F.col("url")))).alias("token"))
    rare = held.join(literal, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    keyed = rules.select("*", F.explode_outer("literals").alias("token")).join(rare, "token", "left")
    order = F.struct(F.coalesce("urls", F.lit(0)), F.length("token"), "token")
    best = keyed.groupBy("rule", "verdict", "site", "regex").agg(F.min_by("token", order).alias("token"))
    return materialise(best.withColumn("token", F.coalesce("token", F.lit(""))), "rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`url`, `best` (the winning rule) for each distinct url that a rule matches."""
    found = index(urls, rules)
    keyed = urls.select("url", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(tokens(F.col("url"))))).alias("token"))
    subject = F.when(F.col("site"), F.concat(F.lit("."), host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.col("url"))
    sited = ~F.col("site") | F.col("url").contains("://")
    hits = keyed.join(found, "token").where(sited & F.rlike(subject, F.col("regex")))
    # The smallest wins: site rules first, allowing patterns before blocking ones, then by length and text.
    rank = F.struct((~F.col("site")).cast("int"), (~F.col("site") & (F.col("verdict") == "block")).cast("int"), -F.length("rule"), "rule", "verdict")
    return hits.groupBy("url").agg(F.min_by(F.struct("rule", "verdict", "site"), rank).alias("best"))


def judge(pages: DataFrame, lines: list[str] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`id`, `host`, `path`, `rule` (the site rule that decides, or null), `verdict`, `pattern` (the pattern that decides, or null)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = rows.select("url").where("url IS NOT NULL").distinct()
    best = matched(urls, compiled(pages.sparkSession, lines)).withColumnRenamed("url", "of")
    named = rows.join(best, F.col("url") == F.col("of"), "left")
    return named.select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(F.col("best.site"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.when(~F.col("best.site"), F.col("best.rule")).alias("pattern"),
    )


def allowed(pages: DataFrame, lines: list[str] | DataFrame, url_col: str = "url") -> DataFrame:
    """The rows of `pages` whose url is allowed, with all their columns."""
    urls = pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    (of,) = fresh("url")
    bad = matched(urls, compiled(pages.sparkSession, lines)).where("best.verdict = 'block'").select(F.col("url").alias(of))
    return pages.join(bad, F.col(f"`{url_col}`") == F.col(of), "left_anti")

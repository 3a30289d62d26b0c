import re

import pytest

from tests.conftest import plan_of
from tidewell.llm import urlrules

LINES = [
    "@@||org/", "||example.org/es/", "||example.org/en/1", "||Shop.net", "||com/a*b", "/ads/", "^track=", "|http://old.", ".exe|", "/x*y/z", "@@/ads/ok/", "ads", "a.b", "", "  ", "/ads/", "*", "@@||only.*",
]
URLS = [
    "http://example.org/es/1", "http://EXAMPLE.org/en/12?q#r", "https://sub.example.org/en/2", "http://xexample.org/es/", "http://org/", "http://org", "https://shop.net", "https://shop.net?x", "https://a.shop.net/q",
    "https://myshop.net/", "http://t.com/a*b/c", "http://t.com/aXb", "http://t.com/ads/1", "http://t.com/ads/ok/", "http://t.com/ADS/1", "http://t.com/?track=1", "http://t.com/xtrack=1", "http://old.com/", "see http://old.com/",
    "http://t.com/f.exe", "http://t.com/f.exe?x", "http://t.com/x1/2y/z", "no scheme example.org/es/", "ads", "", "://", "http:///es/", "a://b://c.org/es/", "http://a_b.com/", "http://t.com/é/ads/ü", "http://t.com/\nads/", "weird?u=http://example.org/es/",
    "http://user@example.org:80/es/", "http://t.net/aab", None,
]


def plain(url, lines):
    """Every rule tried on the url, one after the other."""
    cut = re.match("(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in cut[1]), cut[2]) if cut else ("", "")
    sites, patterns = [], []
    for line in {x.strip() for x in lines} - {""}:
        verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        if body.startswith("||"):
            of, slash, rest = body[2:].partition("/")
            of = of.lower()
            if cut and (host == of or host.endswith("." + of)) and path.startswith(slash + rest):
                sites.append((-len(of + slash + rest), of + slash + rest, verdict))
            continue
        inner = body[1:] if body.startswith("|") else body
        inner = inner[:-1] if inner.endswith("|") else inner
        made = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in inner)
        made = ("^" if body.startswith("|") else "") + made + (r"\Z" if body.endswith("|") else "")
        if url is not None and re.search("(?s)" + made, url):
            patterns.append((verdict == "block", -len(line), line, verdict))
    if sites:
        best = min(sites)
        return host, path, best[1], best[2], None
    if patterns:
        return host, path, None, min(patterns)[3], min(patterns)[2]
    return host, path, None, "allow", None


def judged(spark, urls, lines):
    pages = spark.createDataFrame([(i, u, "x", "x", "x", "x", "x") for i, u in enumerate(urls)], "page_id long, url string, token string, rule string, best string, of string, line string")
    return [(r.host, r.path, r.rule, r.verdict, r.pattern) for r in urlrules.judge(pages, lines).orderBy("id").collect()]


@pytest.mark.parametrize("lines", [LINES, [x for x in LINES if x not in ("*", "ads")], LINES[:3], []])
def test_against_every_rule_on_every_url(spark, lines):
    assert judged(spark, URLS, lines) == [plain(u, lines) for u in URLS]


def test_a_rule_is_kept_under_its_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://common.com/{i}/",) for i in range(20)] + [("http://common.com/rare/",)], "url string")
    rules = urlrules.compiled(spark, ["||common.com/rare/", "/common/absent/x", "mid"])
    found = {r.rule: r.token for r in urlrules.index(urls, rules).collect()}
    assert found == {"common.com/rare/": "rare", "/common/absent/x": "absent", "mid": ""}


def test_candidates_alone_meet_the_expressions(spark):
    """Of 300 rules a url meets those indexed by one of its tokens: here one."""
    urls = spark.createDataFrame([(f"http://site{i}.com/p{i}/",) for i in range(300)], "url string")
    found = urlrules.index(urls, urlrules.compiled(spark, [f"||site{i}.com/p{i}/" for i in range(300)]))
    keyed = urls.selectExpr("url", "explode(regexp_extract_all(url, '([a-z0-9]+)', 1)) AS token")
    assert keyed.join(found, "token").count() == 300


def test_rules_from_a_table_long_urls_and_repeated_rows(spark):
    lines = spark.createDataFrame([("||example.org/es/", 1), ("/deep/", 2)], "line string, n int")
    long = "http://example.com/" + "a/" * 300_000 + "deep/"
    pages = spark.createDataFrame([(1, long), (1, long), (None, "http://example.org/es/"), (None, None)], "page_id long, url string")
    rows = sorted(((r.id or 0, r.verdict) for r in urlrules.judge(pages, lines).collect()))
    assert rows == [(0, "allow"), (0, "block"), (1, "block"), (1, "block")]


def test_allowed_keeps_rows_whole(spark):
    pages = spark.createDataFrame([(1, "http://a.com/ads/"), (2, "http://a.com/"), (3, None), (2, "http://a.com/")], "page_id long, url string")
    kept = urlrules.allowed(pages, ["/ads/"])
    assert kept.columns == pages.columns and sorted(r.page_id for r in kept.collect()) == [2, 2, 3]
    assert urlrules.judge(pages.where("false"), ["/ads/"]).count() == 0


def test_main_path_is_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = plan_of(urlrules.judge(pages, LINES))
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "ExistingRDD", "Cartesian", "NestedLoop"))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import langid

WORDS = {"en": "the river and the stone with this that wood", "fr": "le rivage et la pierre avec cette que bois eau", "de": "der fluss und die stein mit dieser dass holz"}


@pytest.fixture
def model(spark):
    rows = [(i, WORDS[lang] + " " + str(i), lang) for i, lang in enumerate(list(WORDS) * 30)] + [(None, "x", "en"), (900, None, "en"), (901, "x", None)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def page(text, lang=None):
    return f"<!DOCTYPE html><html{f' lang={lang}' if lang else ''}><script>the the der le</script><!-- le le --><body><p>{text}</p></body></html>"


def fused(spark, model, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, p string")
    return langid.fuse(df, model).collect()


def test_visible_text():
    assert langid.visible("a<b>c</b><script>x<y</script>d<!-- e -->&amp;<style>f").split() == ["a", "c", "d", "&"]
    assert len(langid.visible("<script>" * 20_000)) < 10


def test_text_alone(spark, model):
    rows = [(i, None, page(WORDS[lang])) for i, lang in enumerate(["en", "fr", "de"] * 3)]
    assert {r.page: r.lang for r in fused(spark, model, rows)} == {i: ["en", "fr", "de"][i % 3] for i in range(9)}


def test_evidence_decides_where_text_does_not(spark, model):
    sure = [(i, f"http://{'abc'[i % 3]}.site.{['uk', 'fr', 'de'][i % 3]}/x", page(WORDS[["en", "fr", "de"][i % 3]], ["en", "fr", "de"][i % 3])) for i in range(60)]
    unsure = [(100, "http://b.site.fr/", page("12345")), (101, None, page("", "de")), (102, "http://new.other.fr/", page("")), (103, "http://c.site.de/", None)]
    found = {r.page: r for r in fused(spark, model, sure + unsure)}
    assert [found[i].lang for i in (100, 101, 102, 103)] == ["fr", "de", "fr", "de"]
    assert found[100].host == "b.site.fr" and found[101].declared == "de"
    assert all(0 < r.probability <= 1 for r in found.values())


def test_wrong_declaration_does_not_beat_clear_text(spark, model):
    rows = [(i, f"http://h{i % 5}.org/", page(WORDS["en"] * 3, "en")) for i in range(40)] + [(99, "http://h1.org/", page(WORDS["fr"] * 5, "en"))]
    assert {r.page: r.lang for r in fused(spark, model, rows)}[99] == "fr"


def test_rows(spark, model):
    rows = [(1, "not an address", "<p"), (1, "not an address", "<p"), (None, None, None), (2, "http:///", ""), (3, "HTTP://User@Host.Example.:80/a", page("the " * 50_000, "xx"))]
    found = fused(spark, model, rows)
    assert sorted((r.page for r in found), key=repr) == [1, 1, 2, 3, None]
    assert {r.page: r.host for r in found}[3] == "host.example" and {r.page: r.declared for r in found}[3] == "other"
    assert fused(spark, model, []) == []


def test_without_training(spark):
    model = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang for r in fused(spark, model, [(1, None, page("the"))])] == [None]


@pytest.mark.parametrize("url, host, domain, suffix", [
    ("http://news.bbc.co.uk/x", "news.bbc.co.uk", "bbc.co.uk", "uk"), ("https://a.b.site.fr:80/", "a.b.site.fr", "site.fr", "fr"), ("http://192.168.1.20/x", "192.168.1.20", "192.168.1.20", None),
    ("http://[::1]:8080/x", "[::1]", "[::1]", None), ("http://localhost/", "localhost", "localhost", "localhost"), ("ftp://u:p@Host.Org./", "host.org", "host.org", "org"),
    ("http://co.uk/", "co.uk", "co.uk", "uk"), ("nothing", None, None, None), (None, None, None, None),
])
def test_hosts(spark, url, host, domain, suffix):
    df = spark.createDataFrame([(url,)], "url string").select(langid.host_of(F.col("url")).alias("h"))
    row = df.select("h", langid.domain_of(F.col("h")).alias("d"), langid.suffix_of(F.col("h")).alias("s")).first()
    assert (row.h, row.d, row.s) == (host, domain, suffix)


def brute(model, rows):
    """The fusion page by page in plain Python."""
    n, pull, even = len(model.languages), langid.PULL, langid.EVEN
    pages = []
    for page_id, host, domain, suffix, html in rows:
        said = langid.DECLARED.search(html or "")
        declared = None if said is None else said[1].lower() if said[1].lower() in model.languages else "other"
        logs = model.likelihood(langid.visible(html or ""))
        pages.append((page_id, host, domain, suffix, declared, logs, langid.softmax(logs)))

    def sums(key):
        out = {}
        for p in pages:
            if p[key] is not None:
                s, m = out.get(p[key], (np.zeros(n), 0))
                out[p[key]] = s + p[6], m + 1
        return out

    hosts, domains, suffixes, said = (sums(k) for k in (1, 2, 3, 4))
    total = sum((p[6] for p in pages), np.zeros(n))
    overall = (total + even) / (total.sum() + even * n)
    of_language = sum((s for s, _ in said.values()), np.zeros(n))
    found = []
    for page_id, host, domain, suffix, declared, logs, p in pages:
        score = logs.copy()
        if declared is not None:
            score += np.log((said[declared][0] + even) / (of_language + even * len(said)))
        if suffix is not None:
            s, m = suffixes[suffix]
            score += np.log((s + pull * m / total.sum()) / (total + even + pull) / (m / total.sum()))

        def share(table, key, base):
            s, m = table.get(key, (p, 1))
            return (np.maximum(s - p, 0) + pull * base) / (m - 1 + pull)

        prior = share(hosts, host, share(domains, domain, overall))
        score += np.log(prior)
        odds = langid.softmax(score)
        found.append((page_id, model.languages[int(odds.argmax())], round(float(odds.max()), 9)))
    return sorted(found)


def test_fusion_by_brute_force(spark, model):
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        lang = rnd.choice(["en", "fr", "de"])
        words = rnd.sample(WORDS[lang].split(), rnd.randint(0, 4)) + rnd.sample(WORDS[rnd.choice(["en", "fr", "de"])].split(), rnd.randint(0, 3))
        url = rnd.choice([None, f"http://{rnd.choice('abc')}.{rnd.choice(['one', 'two'])}.{rnd.choice(['fr', 'de', 'co.uk'])}/{i}", "http://10.0.0.1/"])
        rows.append((i, url, rnd.choice([page(" ".join(words)), page(" ".join(words), rnd.choice(["en", "fr", "de", "xx"])), None])))
    df = spark.createDataFrame([(i, u) for i, u, _ in rows], "i long, u string").select("i", langid.host_of(F.col("u")).alias("h"))
    cut = {r.i: (r.h, r.d, r.s) for r in df.select("i", "h", langid.domain_of(F.col("h")).alias("d"), langid.suffix_of(F.col("h")).alias("s")).collect()}
    want = brute(model, [(i, *cut[i], html) for i, _, html in rows])
    assert sorted((r.page, r.lang, round(r.probability, 9)) for r in fused(spark, model, rows)) == want


def test_ties_and_repeated_training_rows(spark):
    """Equal evidence goes to the first language; an id counts once however often it is there; rare languages beyond the bound are not learnt."""
    rows = [(i, "same words here", lang) for i, lang in enumerate(["nl", "af"] * 5)]
    model = langid.train(spark.createDataFrame(rows + rows[:1] * 50, "doc_id long, text string, lang string"))
    once = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert (model.logs == once.logs).all() and model.languages == ["af", "nl"]
    assert {r.lang for r in fused(spark, model, [(1, None, page("same words")), (2, None, None)])} == {"af"}


def test_number_of_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, f"text {lang}", lang) for i, lang in enumerate(["en"] * 5 + ["fr"] * 4 + ["de"] * 4 + ["xx"])]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["de", "en"]

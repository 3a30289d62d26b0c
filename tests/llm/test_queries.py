import hashlib
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidewell.llm import pieces, pii, quality, simhash
from tools.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.queries() if n.startswith("op"))


def test_names():
    assert [int(n[2:].split("_")[0]) for n in sorted(NAMES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, entry.queries()[name], entry.oracle_sql().get(name)) == ""


def components(fps):
    """Smallest id reachable over fingerprints at most two bits apart, by trying all pairs."""
    least = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def copies_of(sizes, sources):
    """How often the mix takes each id: targets by filling up, then ids in order of their hash."""
    weights = dict(zip(sorted(set(sources.values()) - {None}) + ([None] if None in sources.values() else []), [3, 1, 2] * len(sizes)))
    total = {s: sum(sizes[i] for i in sizes if sources[i] == s) for s in weights}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(weights)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: float(2 * total[s]) for s in full}
        left, open_ = left - sum(2 * total[s] for s in full), open_ - full
    out = {}
    for s in weights:
        times = int(target[s] // total[s]) if total[s] else 0
        budget, taken = target[s] - times * total[s], 0
        for i in sorted((i for i in sizes if sources[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:15]):
            once_more = budget > 0 and (taken + sizes[i] - budget < budget - taken if taken + sizes[i] > budget else True) and taken <= budget
            out[i] = times + once_more
            taken = taken + sizes[i] if once_more else float("inf")
    return out


def test_pipeline(spark):
    """Its rows are those of the five stages done one document after the other: judged, linked over all pairs, masked from the spans, mixed by sorting, encoded by the library."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    field = quality.train_from(spark, SF_DIR)
    good = {i: r for i, r in docs.items() if quality.judge(field, r.text)[6]}
    least = components({i: simhash.fingerprint(r.text) for i, r in good.items()})
    left = [i for i in good if least[i] == i]
    assert 0 < len(left) < len(good) < len(docs)
    frame = spark.createDataFrame([(i, good[i].text) for i in left], "doc_id long, text string")
    texts = {}
    for r in pii.find(frame).collect():
        spans = sorted((s.start, -s.end, k.name) for k in pii.KINDS for s in r[k.name])
        text, at = "", 0
        for start, back, name in spans:
            if start >= at:
                text += good[r.id].text[at:start] + f"[{name.upper()}]"
            at = max(at, -back)
        texts[r.id] = text + good[r.id].text[at:]
    assert any("[EMAIL]" in t for t in texts.values())
    sizes = {i: len(re.findall("[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    times = copies_of(sizes, {i: good[i].source for i in texts})
    model = pieces.loaded(pieces.model_path())
    want = sorted((i, model.processor.encode(texts[i])) for i in texts for _ in range(times[i]))
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_the_columns(spark, documents, hard_rows):
    docs = documents(hard_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF_DIR).count() == 0

import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import pii

# The base patterns as the contract states them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c_d@e.f x@y@z.w a@b. @ b@ 1.2.3.4.5 999.1.1.1 001.02.3.4 1.2.3 0.0.0.0 1..2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 4111  1111",
    "+1 (234) 555-1234, +12 +1(((( +49-30-1234567. +4 1", "é 🙂 bob.x@mail-1.example.com 🙂 10.0.0.1", "", None, "no data", "1" * 30 + "@" + "." * 5,
    "tel +1 234 567 890 1234 5678", "x" * 3000 + "@y.zz " + "9" * 3000,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in pii.digest(docs).collect():
        mine = [s for s in row.spans.split(",") if s.split(":")[0] in BASE]
        assert mine == brute(TEXTS[row.id]), TEXTS[row.id]
        assert row.n_email == sum(s.startswith("email") for s in mine) and row.n_card == sum(s.startswith("card") for s in mine)


def test_checksums(spark):
    df = spark.createDataFrame([("GB82WEST12345698765432",), ("GB82 WEST 1234 5698 7654 33",)], "t string")
    assert [r[0] for r in df.select(pii.mod97(F.col("t"))).collect()] == [True, False]
    df = spark.createDataFrame([("79927398713",), ("79927398710",)], "t string")
    assert [r[0] for r in df.select(pii.luhn(F.col("t"))).collect()] == [True, False]


def test_context_decides_weak_matches(spark):
    docs = spark.createDataFrame([(1, "SSN 123-45-6789"), (2, "part 123-45-6789"), (3, "x" * 60 + " ssn " + "y" * 60 + " 123-45-6789")], "doc_id long, text string")
    found = {r.id: r.id_number for r in pii.find(docs).collect()}
    assert [(s.start, s.end, s.score) for s in found[1]] == [(4, 15, 0.7)] and not found[2] and not found[3]
    strong = pii.find(spark.createDataFrame([(1, "card 4111111111111111"), (2, "4111111111111111")], "doc_id long, text string")).collect()
    assert {r.id: r.card[0].score for r in strong} == {1: 1.0, 2: 0.7}


def test_rows_and_plan(documents, hard_rows):
    docs = documents(hard_rows + [(30, "mail me@x.org or 10.0.0.1 now", "a"), (30, "mail me@x.org or 10.0.0.1 now", "a")])
    found = pii.digest(docs)
    assert found.count() == len(hard_rows) + 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.where("doc_id = 30").collect()] == ["mail [EMAIL] or [IP] now"] * 2
    assert out.where("doc_id = 3").first().text is None
    assert pii.digest(documents([])).count() == 0 and pii.redact(documents([])).count() == 0


def test_very_long_texts_do_not_recurse(spark):
    text = "1 " * 200_000 + "a" * 200_000 + "@" + "b." * 100_000 + "+1" + "(" * 200_000
    row = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_card == 0 and row.n_email == 1


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_redaction_leaves_no_base_span(spark, text):
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert not [s for s in brute(out) if s.startswith(("email", "ip"))]


def test_redaction_cuts_all_spans_of_the_original(spark):
    """No character of a span that the original has stays, whatever kinds overlap."""
    texts = [
        "é🙂 +33.1.42.68.53.00 end", "+49 30.12.34.56.78", "card +4111 1111 1111 1111, 10.0.0.1", "1.2.3.4@x.org a@1.2.3.4", "a@b.c_d@e.f +1 (234) 555-1234",
        "ssn 123-45-6789", *TEXTS,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: [tuple(s)[:3] for k in pii.KINDS for s in r[k.name]] for r in pii.find(docs).collect()}
    for row in pii.redact(docs).collect():
        text, out, end = texts[row.doc_id], [], 0
        for kind, a, b in sorted(found[row.doc_id], key=lambda s: (s[1], -s[2], s[0])):
            if a >= end:
                out += [text[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        assert row.text == (text if text is None else "".join(out) + text[end:])
    assert pii.redact(docs).first().text == "é🙂 [PHONE] end"


def test_redaction_keeps_columns_of_any_name(spark):
    names = ["__email", "__email__rest", "email", "spans", "text__m", "__spans"]
    docs = spark.createDataFrame([(1, "write to a@b.org now", *range(6))], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    row = pii.redact(docs).first()
    assert row.asDict() == {"doc_id": 1, "text": "write to [EMAIL] now"} | {n: i for i, n in enumerate(names)}

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.loaded(pieces.model_path())


def texts():
    rnd = random.Random(3)
    letters = [*"abcdefghintors  .,\n", "é", "🙂", "▁", "   ", "Ж", "\x00"]
    yield from ["", " ", " " * 40, "x" + " " * 23 + "\t  y", "a" * 50, "<s> <0x41> <unk>", "日本語 テキスト"]
    for _ in range(60):
        yield "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 200)))
    for _ in range(10):
        yield "".join(rnd.choice("abcdething") for _ in range(300))


@pytest.mark.parametrize("chunk", [1, 3, 7, 40, pieces.CHUNK])
def test_ids_are_those_of_the_library(model, chunk):
    for text in texts():
        assert model.encode(text, chunk).tolist() == model.processor.encode(text), (chunk, text)


@pytest.mark.parametrize("block", [1, 7, pieces.BLOCK])
def test_words_merged_side_by_side(model, monkeypatch, block):
    """Every word as merged by itself; rows of letters that tie, unknown characters, words of one and of two letters."""
    monkeypatch.setattr(pieces, "BLOCK", block)
    rnd = random.Random(5)
    words = [pieces.BLANK + "".join(rnd.choice("abcdething") for _ in range(rnd.randint(0, 46))) for _ in range(150)]
    words += [pieces.BLANK + c * n for c in "aest-=" for n in range(1, 40)] + ["a", "th", "Ж", "日本語", "x🙂y", "\x00", "ing.", "%%%", pieces.BLANK]
    found = model.merge_all(words)
    assert [f for f in found if f is not None] == [model.packed(model.merge(w)) for w, f in zip(words, found) if f is not None]
    assert {w for w, f in zip(words, found) if f is None} <= {w for w in words if any(c not in model.ids for c in model.merge(w))}


def test_learned_words_are_encoded_alike(model):
    """New words of many texts are merged at once, none one by one; ids stay those of the library."""
    rnd = random.Random(6)
    many = [" ".join("".join(rnd.choice("abcdethingsors") for _ in range(rnd.randint(1, 12))) + rnd.choice(["", ".", ",\nand", "%%%"]) for _ in range(80)) for _ in range(20)]
    fresh = pieces.Pieces(pieces.model_path())
    fresh.learn([fresh.prepared(t) for t in many])
    fresh.merge = fresh.path = None
    for text in many:
        assert fresh.encode(text).tolist() == model.processor.encode(text)


def test_words_over_lines_are_merged_side_by_side(model):
    """A line's end is a byte piece in this model; a word with one is merged in the arrays like any other, several blanks as well."""
    words = [pieces.BLANK + w for w in ("are.\nThe", "\n", "a\n\nb", "x\ty\x01", pieces.BLANK * 3 + "of")]
    assert model.merge_all(words) == [model.packed(model.merge(w)) for w in words]


def strange(seed):
    """Texts whose words are new, long, without a blank, after several blanks, of unknown characters; some end in blanks, some are empty."""
    rnd = random.Random(seed)
    ends = ["", ".", ",\nand", "%%%", "  ", "   \n", "🙂", "\u0378", "x" * 60, ".\n" * 40]
    return ["", " ", "▁", *("".join(rnd.choice(["", " ", " ", "▁"]) + "".join(rnd.choice("abcdethingsorsé") for _ in range(rnd.randint(0, 12))) + rnd.choice(ends) for _ in range(90)) for _ in range(20))]


@pytest.mark.parametrize("memory, mixed", [(pieces.MEMORY, None), (100, None), (pieces.MEMORY, 0), (100, 7)])
def test_texts_encoded_together(model, monkeypatch, memory, mixed):
    """Ids are the library's if words are forgotten, and if all words of a length, or all words, have one hash."""
    monkeypatch.setattr(pieces, "MEMORY", memory)
    fresh = pieces.Pieces(pieces.model_path())
    if mixed is not None:
        fresh.mixed[:] = mixed
    for many in (strange(1), strange(2), strange(1)):
        found = fresh.together([fresh.prepared(t).replace(pieces.BLANK, " ").encode() for t in many])
        assert [f.tolist() for f in found] == [model.processor.encode(t) for t in many]


def test_slots_hold_what_was_put():
    rnd = np.random.default_rng(2)
    keys = np.unique(np.concatenate((rnd.integers(-(1 << 63), (1 << 63) - 1, 5000), np.arange(3000) << 40)))
    slots = pieces.Slots(10)
    for part in np.array_split(rnd.permutation(len(keys)), 7):
        slots.put(keys[part], part)
    assert (slots.get(keys) == np.arange(len(keys))).all()
    assert (slots.get(keys[~np.isin(keys + 1, keys)] + 1) == -1).all()


def test_decoding_gives_the_text_back(model):
    for text in texts():
        assert model.decode(model.encode(text)) == text.replace("▁", " ")


def test_product_is_associative_and_takes_the_larger_weight():
    a, b, c = {("x", 1): 1.0, ("x", 2): 0.0}, {(1, 1): 0.0, (2, 1): 3.0}, {(1, "y"): 1.0}
    assert pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c)) == {("x", "y"): 4.0}
    assert pieces.states([a, b, c]) == [("x", 2), (2, 1), (1, "y")]


@pytest.mark.parametrize("chunk", [64, pieces.CHUNK])
def test_rows(spark, model, documents, hard_rows, chunk):
    found = pieces.encoded(documents(hard_rows), chunk=chunk).collect()
    want = [(i, None if t is None else model.processor.encode(t)) for i, t, _ in hard_rows]
    assert sorted(((r.id, r.ids) for r in found), key=repr) == sorted(want, key=repr)


def test_empty_and_decoded(spark, documents):
    assert pieces.encoded(documents([])).count() == 0
    found = pieces.encoded(documents([(1, "a b", "s"), (2, None, "s")])).select("id", pieces.decoded().alias("t"), F.size("ids").alias("n"))
    assert sorted((r.id, r.t) for r in found.collect()) == [(1, "a b"), (2, None)]


def test_damaged_ids_decode(model):
    assert isinstance(model.decode(np.array([300, 200])), str)


def test_copies_of_a_long_text_are_encoded_once(spark, model, documents, prose):
    """A third of all rows hold one long text, some under a null id."""
    long = prose(4, 900)
    rows = [(None, long, "a")] * 5 + [(7, long, "a")] * 5 + [(8, long + "!", "a")] + [(100 + i, prose(i), "a") for i in range(20)]
    found = pieces.encoded(documents(rows), chunk=100)
    want = [(i, model.processor.encode(t)) for i, t, _ in rows]
    assert sorted(((r.id, r.ids) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_margin_covers_the_longest_piece(spark, documents, prose, monkeypatch, model):
    assert model.longest <= pieces.MARGIN
    with pytest.raises(ValueError):
        pieces.encoded(documents([(1, "a", "s")]), chunk=pieces.MARGIN - 1)
    monkeypatch.setattr(pieces, "MARGIN", 2)
    with pytest.raises(Exception, match="reaches beyond a margin"):
        pieces.encoded(documents([(1, prose(1, 100), "s")]), chunk=50).collect()


def test_a_giant_text_is_cut_once(spark, model):
    """Four million characters without a word start, then words: time grows with the length, not with its square."""
    digits = F.expr("array_join(transform(sequence(1, 62500), i -> sha2(string(i), 256)), '')")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(digits, F.expr("repeat(' river stone', 100000)")).alias("text"))
    row = pieces.encoded(docs).select(F.size("ids").alias("n"), pieces.decoded().alias("t")).first()
    assert row.t == docs.first().text and row.n == len(model.processor.encode(row.t))

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewell.llm import tokenbin
from tidewell.llm.files import open_input


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenbin.tokenizer_path())


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 13, 16, 17, 24, 31])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for count in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << bits, count).astype("<u4")
        data = tokenbin.pack(ids, bits)
        assert len(data) == tokenbin.packed_bytes(bits, count)
        assert (tokenbin.unpack(data, bits, count) == ids).all()
    assert tokenbin.bits_for(50_257) == 16 and tokenbin.bits_for(1 << 13) == 13 and tokenbin.bits_for(1) == 1


def test_ids_are_those_of_the_library(tokenizer):
    rnd = random.Random(4)
    letters = [*"abcdetionrABC  .,\n\t'123!?-", "é", "🙂", "Ж", "  ", "\x1c", "\x85", "\xa0", "²", "º", "'s", "'LL", "日本", "\r\n", "\x00", " ", "<|endoftext|>"]
    encoder = tokenbin.loaded(tokenbin.tokenizer_path())
    for _ in range(600):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50)))
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_rows(documents, hard_rows, tokenizer):
    """Ids in order, null first, each start the number of ids before; of equal ids the rows in either order."""
    found = sorted(tokenbin.read(tokenbin.write(documents(hard_rows))).collect(), key=lambda r: r.start)
    assert [r.id for r in found] == sorted((i for i, _, _ in hard_rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for row in found:
        assert row.start == start
        start += row["count"]
    want = []
    for doc_id, text, _ in hard_rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r.id, r["count"], r.crc) for r in found), key=repr) == sorted(want, key=repr)


def test_files_are_rolled(documents, prose, tokenizer):
    """By bytes and by documents; the order goes on over the pieces of a part."""
    want = {i: tokenizer.encode(prose(i), add_special_tokens=False).ids + [2] for i in range(60)}
    for bytes_, entries in ((500, 1 << 20), (1 << 28, 3)):
        files = tokenbin.write(documents([(i, prose(i), "a") for i in range(60)]), file_bytes=bytes_, entries=entries)
        assert files.where("piece > 0").count() >= 8 and files.agg({"documents": "max"}).first()[0] <= entries
        start = 0
        for row in sorted(tokenbin.read(files).collect(), key=lambda r: r.id):
            assert (row.start, row["count"], row.crc) == (start, len(want[row.id]), zlib.crc32(np.array(want[row.id], dtype="<u4").tobytes()))
            start += row["count"]


def test_rows_of_one_id_spread(documents, prose):
    """A null id that has most rows, and one row many times over, are dealt to several tasks."""
    files = tokenbin.write(documents([(None, prose(i), "a") for i in range(400)] + [(5, prose(1), "a")] * 400))
    assert files.where("documents >= 20").count() >= 6 and files.agg({"documents": "sum"}).first()[0] == 800


def test_memory_changes_nothing(tokenizer, prose, monkeypatch):
    monkeypatch.setattr(tokenbin, "MEMORY", 30)
    monkeypatch.setattr(tokenbin, "KEEP", 6)
    encoder = tokenbin.Encoder(tokenbin.tokenizer_path())
    for i in [*range(20), *range(20)]:
        assert encoder.encode(prose(i)).tolist() == tokenizer.encode(prose(i), add_special_tokens=False).ids
    assert len(encoder.known) <= 60 and max(map(len, encoder.known)) <= 6


def test_tokenizers_that_cut_otherwise(prose):
    """Another file's texts are not cut by this module's pattern."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = tokenbin.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.cuts and tokenbin.Encoder(tokenbin.tokenizer_path()).cuts
    for text in (prose(1), "Don't  stop\n123", ""):
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_random_access_and_order(documents, prose, tokenizer):
    rows = [(i * 7 % 50, prose(i), "a") for i in range(50)]
    files = tokenbin.write(documents(rows)).orderBy("part", "piece").collect()
    ids, text = [], {i: t for i, t, _ in rows}
    for file in files:
        with open_input(file.uri) as stream:
            opened = tokenbin.TokenFile(stream)
            for place in reversed(range(file.documents)):
                want = tokenizer.encode(text[int(opened.entries[place]["id"])], add_special_tokens=False).ids + [2]
                assert opened.ids(place).tolist() == want
            ids += opened.entries["id"].tolist()
    assert ids == sorted(ids) and len(ids) == 50


def test_empty(documents):
    assert tokenbin.read(tokenbin.write(documents([]))).count() == 0

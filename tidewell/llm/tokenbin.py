"""Token ids in binary files of fixed bit width.

Every text is encoded, an end id is added, and the ids are stored in the fewest bits that the vocabulary needs. Files hold
the documents in ascending id order; each file has a contiguous range of it.

File format, little-endian: magic `TWTB`, version (u16), bits (u16), then one block for each run of documents:
ids packed from the lowest bit on, each document's ids starting at a byte. A footer follows: for each document its id
(i64, with a flag byte for null), the byte offset of its ids (u64) and their number (u64); the footer's offset, the number of
documents and the magic again end the file. So any document is read by one seek, and numpy unpacks a block at once.

Plan: texts are dealt out by ranges of the id and sorted there (compressed texts are smaller than their ids); each range is encoded into
files of about `FILE_BYTES` and at most `ENTRIES` documents, so a task holds one footer. Ranges go on by a hash of the text and the row's number, so many rows of one id, or
without one, spread like others. `start` of a document is the number of ids in the files before and in its file before it.

Defined results: a null text is empty: it has the end id only; equal ids are neighbours, in order of their texts' hashes; null ids come
first; an empty table gives no file; columns besides id and text are not read. A tokenizer file that does not cut texts the way this module does is asked for whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .files import Output, folder, open_input

MAGIC, VERSION, END = b"TWTB", 1, 2
#: Pre-tokens remembered by a worker, in each of two generations; those over KEEP characters are not.
MEMORY, KEEP = 400_000, 40
FILE_BYTES, ENTRIES = 256 << 20, 1 << 20
ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("at", "<u8"), ("count", "<u8")])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as `bits` bits each, lowest first."""
    if bits % 8 == 0:
        return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    places = np.arange(bits, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> places) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if bits % 8 == 0:
        out = np.zeros((count, 4), dtype=np.uint8)
        out[:, : bits // 8] = raw[: count * bits // 8].reshape(count, bits // 8)
        return out.view("<u4").ravel()
    found = np.unpackbits(raw, bitorder="little", count=count * bits).reshape(count, bits).astype(np.uint32)
    return (found << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def packed_bytes(bits: int, count: int) -> int:
    return -(-bits * count // 8)


class Encoder:
    """The tokenizer with a memory of pre-tokens, which it encodes independently of each other."""

    #: Fixed value: the vocabulary's pattern of pre-tokens.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: Texts of these characters only are cut by the standard library's faster expression with the same result.
    PLAIN = re.compile(r"[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]*+", re.S)
    LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
    FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(self.PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path) as file:
            said = json.load(file)
        cuts = said.get("pre_tokenizer") or {}
        #: Whether the file asks for that pattern, on texts as they are.
        self.cuts = said.get("normalizer") is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")

    def direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the tokenizer gives them."""
        if not self.cuts or any(t in text for t in self.added):
            return np.array(self.direct(text), dtype="<u4")
        parts = self.FAST.findall(text) if self.PLAIN.fullmatch(text) else self.cut(text)
        found = list(map(self.known.get, parts))
        if None in found:
            new = self._learn({p for p, ids in zip(parts, found) if ids is None})
            found = [new[p] if ids is None else ids for p, ids in zip(parts, found)]
        return np.frombuffer(b"".join(found), dtype="<u4")

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens that the newer generation does not know."""
        out = {p: ids for p in parts if (ids := self.older.get(p)) is not None}
        fresh = [p for p in parts if p not in out]
        for part, coded in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            out[part] = np.array(coded.ids, dtype="<u4").tobytes() if len(coded.ids) > 8 else struct.pack(f"<{len(coded.ids)}I", *coded.ids)
        if len(self.known) + len(out) > MEMORY:
            self.older = dict(self.known)
            self.known.clear()
        self.known.update((p, ids) for p, ids in out.items() if len(p) <= KEEP)
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write(docs: DataFrame, base: str | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, file_bytes: int = FILE_BYTES, entries: int = ENTRIES) -> DataFrame:
    """Write the files; returns `uri`, `part` and `piece` (its place in the order), `documents`, `tokens` of each."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    path, base = path or tokenizer_path(), base or folder(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("row")]
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    shape = pa.schema([("uri", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core
        encoder, place, piece, out = loaded(path), TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = out or Writer(base, bits_for(encoder.vocabulary))
                out.add(id_, np.append(encoder.encode(text or ""), np.uint32(end)))
                if out.out.size >= file_bytes or len(out.entries) >= entries:
                    yield out.close(place, piece, shape)
                    piece, out = piece + 1, None
        if out is not None:
            yield out.close(place, piece, shape)

    return materialise(laid.mapInArrow(run, "uri string, part int, piece int, documents long, tokens long"), "token_files")


class Writer:
    """One file in the making."""

    def __init__(self, base: str, bits: int):
        self.bits, self.out = bits, Output(base, ".tok")
        self.out.write(MAGIC + struct.pack("<HH", VERSION, bits))
        self.entries: list[tuple] = []
        self.tokens = 0

    def add(self, id_: int | None, ids: np.ndarray) -> None:
        self.entries.append((id_ or 0, id_ is None, self.out.write(pack(ids, self.bits)), len(ids)))
        self.tokens += len(ids)

    def close(self, part: int, piece: int, shape):
        import pyarrow as pa

        at = self.out.write(np.array(self.entries, dtype=ENTRY).tobytes())
        self.out.write(struct.pack("<QQ", at, len(self.entries)) + MAGIC)
        self.out.close()
        return pa.RecordBatch.from_pylist(
            [{"uri": self.out.uri, "part": part, "piece": piece, "documents": len(self.entries), "tokens": self.tokens}], schema=shape
        )


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(0)
        head = stream.read(8)
        stream.seek(size - 20)
        at, count, magic = struct.unpack("<QQ4s", stream.read(20))
        if head[:4] != MAGIC or magic != MAGIC:
            raise ValueError("not a token file")
        self.bits = struct.unpack("<HH", head[4:])[1]
        stream.seek(at)
        self.entries = np.frombuffer(stream.read(count * ENTRY.itemsize), dtype=ENTRY)

    def ids(self, place: int) -> np.ndarray:
        entry = self.entries[place]
        count = int(entry["count"])
        self.stream.seek(int(entry["at"]))
        return unpack(self.stream.read(packed_bytes(self.bits, count)), self.bits, count)


READ = "id long, start long, count long, crc long"


def read(files: DataFrame) -> DataFrame:
    """`id`, `start`, `count`, `crc` of each document in the files that `uri`, `part` and `piece` name."""
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offset = files.select("uri", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("offset"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, offset in zip(batch["uri"], batch["offset"]):
                with open_input(uri) as stream:
                    found = TokenFile(stream)
                    counts = found.entries["count"].astype(np.int64)
                    ids = pd.array(found.entries["id"].astype(np.int64), dtype="Int64")
                    ids[found.entries["null"].astype(bool)] = pd.NA
                    starts = int(offset) + np.cumsum(counts) - counts
                    for at in range(0, len(counts), 4096):
                        to = min(at + 4096, len(counts))
                        crcs = [zlib.crc32(found.ids(k).astype("<u4").tobytes()) for k in range(at, to)]
                        yield pd.DataFrame({"id": ids[at:to], "start": starts[at:to], "count": counts[at:to], "crc": crcs})

    return offset.repartition(parts, "uri").mapInPandas(run, READ)

"""WARC archives compressed with a Zstandard dictionary, one frame for each record.

An archive starts with a skippable frame that holds a dictionary made from the archive's own first records
(up to `SAMPLE` bytes of them); every record follows as a frame of its own, compressed with that dictionary, so
records can be read one by one. Each task writes archives of at most about `ARCHIVE` bytes of records, from the rows it has:
payloads are not shuffled to be written. A row's payload that another row shows first (equal digest, at least `LEAST`
bytes, smaller page id) becomes a revisit record that names the other: digests are counted first, and only those of
several rows are joined back.

Defined results: a null payload is empty; payloads under `LEAST` bytes are always responses; all rows with the smallest
id of a digest are responses, also if the id is repeated; a row with a null id is a revisit if a row with an id has its payload, else a
response; ids that are null stay null; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .files import Output, folder, open_input

LEAST = 100
ARCHIVE, SAMPLE, DICTIONARY = 64 << 20, 2 << 20, 64 << 10
#: Fixed values of the formats: the skippable frame's magic number, WARC version, the revisit profile.
SKIPPABLE = 0x184D2A5D
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def classify(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """`page`, `url`, `html`, `digest`, `first`: the smallest page with the same payload where another row has it, else null."""
    raw = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), raw.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    shown = rows.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = materialise(shown.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "digests")
    joined = rows.join(shared, "digest", "left")
    return joined.withColumn("first", F.when(F.coalesce(F.col("page") != F.col("first"), F.lit(True)), F.col("first")))


def record_id(page: int | None) -> str:
    name = uuid.uuid5(SPACE, str(page)) if page is not None else uuid.uuid4()
    return f"<urn:uuid:{name}>"


def record(page: int | None, url: str | None, html: bytes, digest: str, first: int | None) -> bytes:
    """A record's bytes: WARC header, HTTP header and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if first is not None else http + html
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page-Id", str(first))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """A dictionary from records; of their bytes as they are if there is too little to train on."""
    import zstandard

    parts = [r[:8192] for r in records]
    total = sum(map(len, parts))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, total // 10)), parts, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(parts)[-DICTIONARY:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive. The first records wait until there are enough for the dictionary."""

    def __init__(self, base: str):
        self.out, self.waiting, self.size, self.count, self.compress = Output(base, ".warc.zst"), [], 0, 0, None

    def add(self, data: bytes) -> None:
        self.size, self.count = self.size + len(data), self.count + 1
        if self.compress:
            self.out.write(self.compress(data))
        else:
            self.waiting.append(data)
            if self.size >= SAMPLE:
                self._start()

    def _start(self) -> None:
        import zstandard

        made = dictionary(self.waiting)
        held = made.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(held)) + held)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=True).compress
        for data in self.waiting:
            self.out.write(self.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if not self.compress:
            self._start()
        self.out.close()
        return self.out.uri, self.count, self.out.size


def write(classified: DataFrame, base: str) -> DataFrame:
    """Write the rows of `classify` to archives below `base`; returns `uri`, `records`, `bytes` of each archive."""
    small_batches(classified.sparkSession)
    rows = classified.select("page", "url", "html", "digest", "first")

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        archive = None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or Archive(base)
                archive.add(record(*row))
                if archive.size >= ARCHIVE:
                    done.append(archive.close())
                    archive = None
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("uri", "records", "bytes"), d)) for d in done], schema=shape)
        if archive:
            yield pa.RecordBatch.from_pylist([dict(zip(("uri", "records", "bytes"), archive.close()))], schema=shape)

    import pyarrow as pa

    shape = pa.schema([("uri", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return materialise(rows.mapInArrow(run, "uri string, records long, bytes long"), "archives")


def frames(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after the other; a record is held whole, the archive is not."""
    import zstandard

    kind, size = struct.unpack("<II", stream.read(8))
    if kind != SKIPPABLE:
        raise ValueError("no dictionary frame")
    held = stream.read(size)
    trained = held[:4] == b"\x37\xa4\x30\xec"
    made = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    reader = zstandard.ZstdDecompressor(dict_data=made)
    rest = b""
    while True:
        rest = rest or stream.read(block)
        if not rest:
            return
        one, out = reader.decompressobj(), []
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(block)
            if not rest:
                raise ValueError("an archive ends within a record")
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def described(data: bytes) -> dict:
    """What a record says of its page; a response's digest and size are those of the payload that it holds."""
    fields, http, payload = parse(data)
    own = fields["WARC-Type"] == "response"
    said = fields["WARC-Payload-Digest"].partition(":")[2]
    digest = hashlib.sha256(payload).hexdigest() if own else said
    if digest != said:
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not have its digest")
    page, first = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": int(page) if page is not None else None, "payload_bytes": len(payload) if own else int(http["Content-Length"]),
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(first) if first is not None else None,
    }


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame) -> DataFrame:
    """`READ` for each record of the archives that `uri` names."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shape = pa.schema([(n.split()[0], pa.string() if n.endswith("string") else pa.int64()) for n in READ.split(", ")])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                out = []
                with open_input(uri) as stream:
                    for data in frames(stream):
                        out.append(described(data))
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, schema=shape)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=shape)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("uri").repartition(parts, "uri").mapInArrow(run, READ)


def archive(pages: DataFrame, base: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archive the rows below `base` (default: a fresh shared folder); returns the archives written."""
    return write(classify(pages, id_col, url_col, payload_col), base or folder(pages.sparkSession, "warc"))

"""WARC archives, written index first and read by coalesced byte ranges.

Writing gives an index row (archive, offset, length, url, digest, ...) for each record. Reading takes index
rows, of all records or of some, sorts them by archive and offset, joins neighbours to one range where little
lies between, and asks the store for ranges only. Records are gzip members of their own, so a range
starts and ends at records.

Of records with equal payloads of at least ``LEAST`` bytes the one with the largest key is a response; the
others are revisits that name it and carry no payload. Archives go to the shared folder under names that no
other attempt of a task uses: a task that runs again leaves an archive that no index row names.

Defined results: a null html is an empty payload; rows without a key are responses unless a keyed row has
the same payload; repeated rows are records of their own, those with the largest key all responses; very long pages are
one record each, held whole by one task; extra columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import pieces
from .workspace import Workspace

LEAST = 1000
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: A read task gets about ``RANGE_BYTES``; of a set that would make more tasks than this, larger shares.
TASKS = 20_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def _header_value(url: str | None) -> str:
    """A URL with what would end a header line percent-encoded."""
    return (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _url(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not yet compressed. refers_to: the key of the response, for revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Key: {'' if key is None else key}",
        f"X-Url-Is-Null: {int(url is None)}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict[str, object]:
    """key, url, html (None for revisits), payload_bytes, payload_digest, record_type and refers_to of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if first != "WARC/1.1" or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"no whole WARC record: {first!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return {
        "key": int(fields["X-Key"]) if fields["X-Key"] else None,
        "url": None if fields["X-Url-Is-Null"] == "1" else _url(fields["WARC-Target-URI"]),
        "html": None if revisit else payload.decode(),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Key"]) if revisit else None,
    }


INDEX = "archive string, offset long, length long, url string, payload_digest string, key long, record_type string"
_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("key", pa.int64()), ("record_type", pa.string())])


def write(df: DataFrame, work: Workspace, key: str = "page_id", url: str = "url", html: str = "html", level: int = 1) -> DataFrame:
    """Archives of all rows under ``work``, and their index."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    large = rows.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.max("key").alias("last"), F.count("*").alias("n"))
    last = work.put("last", large.filter("n > 1 and last is not null").select(F.col("digest").alias("d"), "last"))
    named = rows.join(last, (F.col("digest") == F.col("d")) & (F.col("size") >= LEAST), "left")
    sent = named.select("key", "url", "html", "digest", F.expr("CASE WHEN key IS NULL OR key <> last THEN last END").alias("refers_to"))
    folder = work.path("archives")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            for part in pieces(batch):
                found = []
                for k, u, h, d, r in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        store, path = pafs.FileSystem.from_uri(name)
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    press = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = press.compress(record(k, u, h.encode(), d, r)) + press.flush()
                    out.write(member)
                    found.append((name, at, len(member), u, d, k, "response" if r is None else "revisit"))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _INDEX, strict=True)], schema=_INDEX)
        if out is not None:
            out.close()

    return work.put("index", sent.mapInArrow(run, INDEX))


def ranges(found: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of the reads that cover sorted (offset, length) pairs [first, last)."""
    out: list[list[int]] = []
    for i, (offset, length) in enumerate(found):
        if out and offset - out[-1][1] <= GAP_BYTES and offset + length - out[-1][0] <= RANGE_BYTES:
            out[-1][1], out[-1][3] = max(out[-1][1], offset + length), i + 1
        else:
            out.append([offset, offset + length, i, i + 1])
    return [tuple(x) for x in out]


_RECORD = [("key", pa.int64(), "long"), ("url", pa.string(), "string"), ("html", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long")]


def read(index: DataFrame, with_html: bool = True) -> DataFrame:
    """The records that the index rows name; html is null for revisits. Every payload is held against its digest."""
    columns = [c for c in _RECORD if with_html or c[0] != "html"]
    schema = pa.schema([(n, t) for n, t, _ in columns])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            archive, offset, length = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(archive):
                j = next((k for k in range(i, len(archive)) if archive[k] != archive[i]), len(archive))
                store, path = pafs.FileSystem.from_uri(archive[i])
                with store.open_input_file(path) as source:
                    spots = list(zip(offset[i:j], length[i:j], strict=True))
                    for start, end, a, b in ranges(spots):
                        raw = source.read_at(end - start, start)
                        found = [parsed(zlib.decompress(raw[o - start : o - start + n], 31)) for o, n in spots[a:b]]
                        yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t, _ in columns], schema=schema)
                i = j

    # index rows are small beside what they name, so the number of tasks comes from the bytes to read
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = min(TASKS, -(-total // RANGE_BYTES)) or 1
    return index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in columns))

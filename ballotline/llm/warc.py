"""A deterministic sharded WARC writer, and the reader that takes its archives back.

Writing. Records with equal payloads (SHA-1) are found by one aggregation over
digests: the largest page id of each is the response, the others revisit it.
Records are range-sorted by page id. Shards are ranges of about ``shard_bytes``: a histogram over the ids' leading bits,
whose heavy cells are cut further, gives the bytes before each cell, and ids stand evenly inside a cell. It has a bounded
number of cells whatever the number of rows and shards, and depends on the rows alone, so the files do too. The html is shuffled
once, by range; which records revisit others is found on narrow rows, which meet their html in the writer. Every shard is written
as gzip members, one a record; a file is closed once it holds ``roll_bytes``.

Commit. A task writes to names that hold its own random token and reports them in
a manifest, a table of its own. Only files that the manifest names (those of tasks
that succeeded) are then renamed to their final names, which may be done again after
a loss; what lost tasks left is removed, and the final manifest comes last. An
archive without its manifest isn't there.

Files go through pyarrow's filesystems (local, S3, GCS, HDFS), never a local folder
of an executor. Memory: one record, and one batch of rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, map_arrow, new_path

#: Payload bytes in a shard, about; compressed bytes after which a file is closed.
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
#: Records carry this time, so that writing again gives the same bytes.
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes that a task writes, about, once there are more shards than twice the cores.
TASK_BYTES = 128 << 20
#: Bits of the histogram's first cells and of each cut of a heavy one; a cell is heavy with more than its share of one in HEAVY.
_FIRST, _CUT, HEAVY = 12, 8, 1024
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:ballotline:warc")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _clean(s: str) -> str:
    """A header value on one line."""
    return " ".join(s.split())


def record(page_id: int | None, url: str | None, payload: bytes, is_response: bool, refers_to: int | None, refers_url: str | None = None, copy: int = 0) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, with the full payload's length, and leaves out the payload."""
    digest = base32(hashlib.sha1(payload).digest())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if is_response else head
    name = lambda page: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page} {digest}')}>"
    own = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest} revisit {url} {copy}')}>" if not is_response else name(page_id)
    fields = [
        ("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url or "urn:none")),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if not is_response:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member with no time in it."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _writer(root: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, page_id, sha1, url, html, note, refers_to) in order, before copies a note of what they refer to; out a row for each file."""
        fs, base = _open(root)
        token = uuid.uuid4().hex
        out, shard, seq, count, size, total, last, copy, first, noted = None, None, 0, 0, 0, hashlib.sha1(), None, 0, None, None

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"shard": shard, "seq": seq, "temp": temp, "name": final, "records": count, "bytes": size, "sha1": total.hexdigest(), "first_page": first}], schema=_MANIFEST)

        for b in batches:
            for r in b.to_pylist():
                key = (r["page_id"], r["sha1"])
                if r["note"]:
                    noted = key, r["refers_to"]
                    continue
                dup, refers_to = noted is not None and noted[0] == key, noted[1] if noted else None
                if out and (r["shard"] != shard or size >= roll):
                    yield closed()
                    seq = 0 if r["shard"] != shard else seq + 1
                    out = None
                if not out:
                    shard, count, size, total, first = r["shard"], 0, 0, hashlib.sha1(), r["page_id"]
                    final = f"part-{shard:05d}-{seq:05d}.warc.gz"
                    temp = f"_temp/{final}.{token}"
                    out = fs.open_output_stream(f"{base}/{temp}", compression=None)
                # of rows alike in id and payload only the first is the response
                copy = copy + 1 if key == last else 0
                is_response = not dup or (r["page_id"] == refers_to and key != last)
                last = key
                data = member(record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), is_response, refers_to, copy=copy))
                out.write(data)
                total.update(data)
                count += 1
                size += len(data)
        if out:
            yield closed()

    return run


_MANIFEST = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("temp", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()), ("first_page", pa.int64())])
_MANIFEST_SQL = "shard long, seq long, temp string, name string, records long, bytes long, sha1 string, first_page long"


def _rename(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for b in batches:
            for r in b.to_pylist():
                temp, name = f"{base}/{r['temp']}", f"{base}/{r['name']}"
                if fs.get_file_info(temp).type == pafs.FileType.File:  # else an earlier try did it
                    fs.move(temp, name)
                found = fs.get_file_info(name)
                if found.size != r["bytes"]:
                    raise OSError(f"{name} has {found.size} bytes, its manifest says {r['bytes']}")
            yield b

    return run


_MIN = -(1 << 63)


def _cells(held: DataFrame) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(all bytes, [(bits, cell, bytes before it, its bytes)]) of (page_id, bytes), cells in the order of ids; null ids, which come first, as (0, 0, 0, bytes).

    A cell is a common start of so many bits. At the driver are at most 2^_FIRST cells, and for each further cut HEAVY * 2^_CUT.
    """
    held = held.withColumn("u", F.col("page_id").bitwiseXOR(F.lit(_MIN)))
    lo, hi, total, none = held.agg(F.min("page_id"), F.max("page_id"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("bytes"))), F.lit(0))).first()
    out, before = [(0, 0, 0, none)], none
    if lo is None:
        return total, out
    bits = min(64, 64 - ((lo ^ hi) & ((1 << 64) - 1)).bit_length() + _FIRST)
    rows, done = held.where("page_id IS NOT NULL"), []
    while True:
        found = [(r.cell, r.b) for r in rows.groupBy(F.shiftrightunsigned("u", 64 - bits).alias("cell")).agg(F.sum("bytes").alias("b")).collect()]
        heavy = [c for c, b in found if b * HEAVY > total] if bits < 64 else []
        done += [(bits, c, b) for c, b in found if c not in set(heavy)]
        if not heavy:
            break
        cut = held.sparkSession.createDataFrame([(c,) for c in heavy], "cell long")
        rows = rows.withColumn("cell", F.shiftrightunsigned("u", 64 - bits)).join(F.broadcast(cut), "cell", "left_semi").drop("cell")
        bits = min(64, bits + _CUT)
    for k, c, b in sorted(done, key=lambda x: (x[1] & ((1 << 64) - 1)) << (64 - x[0])):
        out.append((k, c, before, b))
        before += b
    return total, out


def _sharded(held: DataFrame, cells: list[tuple[int, int, int, int]], shards: int, shard_bytes: int) -> DataFrame:
    """``held`` (page_id, sha1, ...) with its ``shard``. Rows of one id, or of none, are dealt out by their digests, so that only rows alike in both are sure to be together."""
    held = held.withColumn("u", F.col("page_id").bitwiseXOR(F.lit(_MIN)))
    if shards == 1:
        return held.withColumn("shard", F.lit(0).cast("long")).drop("u")
    digest = F.conv(F.hex(F.substring("sha1", 1, 6)), 16, 10).cast("double") / float(1 << 48)
    at = F.when(F.col("page_id").isNull(), digest * float(cells[0][3]))
    names = held.columns
    for bits in sorted({c[0] for c in cells[1:]}):
        # bounded as said in _cells, whatever the number of rows and shards
        table = held.sparkSession.createDataFrame([(c, float(before), float(b)) for k, c, before, b in cells if k == bits], f"c{bits} long, before{bits} double, bytes{bits} double")
        held = held.withColumn(f"c{bits}", F.shiftrightunsigned("u", 64 - bits)).join(F.broadcast(table), f"c{bits}", "left")
        inside = F.shiftrightunsigned(F.shiftleft("u", bits), 11).cast("double") / float(1 << 53) if bits < 64 else digest
        at = F.coalesce(at, F.col(f"before{bits}") + inside * F.col(f"bytes{bits}"))
    shard = F.least(F.floor(at / float(shard_bytes)), F.lit(shards - 1))
    return held.withColumn("shard", shard.cast("long")).select(*[n for n in names if n != "u"], "shard")


def write(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes every row of (page_id, url, html) to archives under ``root`` and returns their manifest.

    Null html is an empty payload; a null url is written as urn:none; null ids sort first and
    read back as null. Rows alike in id and payload: one is the response, the others revisit it.
    Further columns are not written. An empty table gives a manifest with no rows.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha1(html)).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"))
    narrow = Table(held.select("page_id", "sha1", "bytes"), "pages")
    same = narrow.df.groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1").select("sha1", "refers_to")
    total, cells = _cells(narrow.df.select("page_id", "bytes"))
    n_shards = max(1, -(-total // shard_bytes))
    held, notes = (_sharded(x, cells, n_shards, shard_bytes) for x in (held, narrow.df.join(same, "sha1")))
    none = lambda kind: F.lit(None).cast(kind)
    rows = held.select("shard", "page_id", "sha1", "url", "html", F.lit(False).alias("note"), none("long").alias("refers_to"))
    rows = rows.union(notes.select("shard", "page_id", "sha1", none("string"), none("string"), F.lit(True), "refers_to"))
    fs, base = _open(root)
    fs.create_dir(f"{base}/_temp", recursive=True)
    tasks = min(n_shards, max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))
    rows = rows.repartitionById(tasks, F.floor(F.col("shard") * tasks / n_shards).cast("int"))
    rows = rows.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha1", F.col("note").desc(), "url")
    done = Table(map_arrow(rows, _writer(root, roll_bytes), _MANIFEST_SQL), "warc-manifest")
    map_arrow(done.df.repartition("name"), _rename(root), _MANIFEST_SQL).write.format("noop").mode("overwrite").save()
    fs.delete_dir(f"{base}/_temp")
    narrow.drop()
    manifest = done.df.drop("temp")
    manifest.write.json(f"{root}/manifest")
    return manifest


def records(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of every record of a gzip archive, read a chunk at a time."""
    z, text = zlib.decompressobj(31), bytearray()
    while True:
        chunk = stream.read(1 << 18)
        if not chunk:
            break
        while chunk:
            text += z.decompress(chunk)
            chunk = b""
            if z.eof:
                chunk, z = z.unused_data, zlib.decompressobj(31)
                yield _parsed(bytes(text))
                text = bytearray()
    if text:
        raise OSError("the archive ends within a record")


def _fields(raw: bytes) -> dict:
    lines = raw.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _parsed(raw: bytes) -> tuple[dict, bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise OSError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise OSError(f"record {fields.get('warc-record-id')} is damaged")
    return fields, block


def _reader(root: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.string())] if payloads else []))
        for b in batches:
            for r in b.to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{r['name']}", compression=None) as stream:
                    for fields, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest != base32(hashlib.sha1(payload).digest()):
                            raise OSError(f"record {fields['warc-record-id']} has another payload")
                        number = lambda k: int(fields[k]) if fields.get(k) else None  # noqa: B023, E731
                        row = {"page_id": number("x-page-id"), "url": None if fields["warc-target-uri"] == "urn:none" else fields["warc-target-uri"], "payload_bytes": int(_fields(http)["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id")}
                        if payloads:
                            row["payload"] = payload.decode("utf-8", "surrogatepass") if kind == "response" else None
                            held += len(payload)
                        rows.append(row)
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read(spark: SparkSession, root: str, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record of the archives under ``root``.

    Digests of blocks and of payloads are checked. A revisit's length is that of the full payload, its ``payload`` null.
    """
    files = spark.read.schema("name string, bytes long").json(f"{root}/manifest")
    n = max(1, spark.sparkContext.defaultParallelism * 2)
    sql = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload string" if payloads else "")
    return map_arrow(files.repartition(n, "name"), _reader(root, payloads), sql)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    root = new_path(pages.sparkSession, "warc")
    write(pages, root)
    return read(pages.sparkSession, root).drop("url")

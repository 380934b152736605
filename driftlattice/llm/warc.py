"""WARC archives as a PySpark Python data source, and the digest columns of a table of pages.

Writing: each task writes one archive file of WARC/1.1 records into the target folder through pyarrow's file systems; a
file takes part only once the driver has committed its name in a manifest, so files of lost or repeated tasks are
ignored. A payload is the body of an HTTP block, with a transfer coding when that is shorter; its digest is that of the
plain payload. Pages have no time, so WARC-Date is the parameter `date`.

Reading: of a folder with manifests, their files, in byte ranges of about `range_bytes` that begin at records (each
file's manifest entry lists such places); otherwise all files *.warc and *.warc.gz in the folder, or the one file that
the path names, one partition for each. Equality predicates on record_type, page_id, url and payload_digest are pushed
down: a record's header is parsed first, and the payload of a record that fails them is stepped over undecoded. With
option payload=false no payload is decoded at all. Payloads that are read are held against their digests.

Foreign records: page_id and refers_to are null (they are fields of this writer); record_type is their WARC-Type; the
payload is the HTTP body without transfer codings (content codings stay), of other records the block; payload_bytes and
payload_digest come from the header, or from the payload where that is read; a block must fit its WARC-Block-Digest.

Revisits: of records with equal payloads, that with the largest page_id is the response and the others refer to it.
Defined results: a null html is an empty payload; a null page_id is smaller than any other and reads back as null;
rows that repeat with the same page_id and payload are all responses if theirs is the largest; an empty table gives
no rows; columns besides page_id, url and html are left out. `refers_to` is null for responses. A path that does not
exist and a file that is cut off are errors.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage

from driftlattice.llm.textbuf import checkpoint_dir

SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
PUSHED = {"record_type", "page_id", "url", "payload_digest"}


def folder(path: str):
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


DATE = "1970-01-01T00:00:00Z"


def record(page_id, url, kind: str, refers_to, payload: bytes, refers_to_url=None, date: str = DATE) -> bytes:
    """One record; a revisit has no block."""
    uri = lambda x: quote(x or "", safe=":/?#[]@!$&()*+,;=~-._%")
    names = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri(url)}",
        f"WARC-Payload-Digest: sha1:{sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    block = b""
    if kind == "revisit":
        names += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {uri(refers_to_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    else:
        packed = zlib.compress(payload, 1)
        if len(packed) < len(payload):
            block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: deflate\r\n\r\n" + packed
        else:
            block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = "\r\n".join(["WARC/1.1", *names, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(lines) -> dict[str, str]:
    """Header fields by name in lower case; a line that begins with a space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        key, _, value = line.decode("utf-8", "replace").partition(":")
        name = key.strip().lower()
        out[name] = value.strip()
    return out


def header(file) -> dict[str, str] | None:
    """The fields of the next record; None at the end of the file."""
    while (first := file.readline()) in (b"\r\n", b"\n"):
        pass
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {first[:40]!r}")
    return fields(iter(file.readline, b"\r\n")) if first.endswith(b"\r\n") else fields(iter(file.readline, b"\n"))


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        n = int(body[at:end].split(b";")[0] or b"0", 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def payload_of(block: bytes, kind: str = "application/http") -> bytes:
    """The payload of a block: the body of an HTTP message without its transfer codings, else the block."""
    if not kind.startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    codings = fields(head.split(b"\r\n")[1:]).get("transfer-encoding", "")
    for coding in reversed([c.strip().lower() for c in codings.split(",")]):
        if coding == "chunked":
            body = dechunked(body)
        elif coding in ("deflate", "gzip", "x-gzip"):
            body = zlib.decompress(body, 47)  # either kind of header
    return body


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.want: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.want.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        store, root = folder(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [Range(root, 0, -1)]
        files = store.get_file_info(fs.FileSelector(root))
        out = []
        manifests = [f for f in files if f.base_name.startswith("_manifest-")]
        for info in manifests:
            with store.open_input_stream(info.path) as file:
                entries = json.loads(file.read())
            for name, marks in entries:
                cuts = [marks[0]]
                for m in marks[1:-1]:
                    if m - cuts[-1] >= self.range_bytes:
                        cuts.append(m)
                cuts.append(marks[-1])
                out += [Range(f"{root}/{name}", a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        if not manifests:
            out = [Range(f.path, 0, -1) for f in files if f.base_name.endswith((".warc", ".warc.gz"))]
        return out or [Range("", 0, 0)]

    def read(self, part):
        if not part.file:
            return
        store, _ = folder(self.path)
        with io.BufferedReader(store.open_input_file(part.file), 1 << 18) as raw:
            raw.seek(part.start)
            whole = part.end < 0
            file = gzip.GzipFile(fileobj=raw) if part.file.endswith(".gz") else raw
            rows = []
            while whole or raw.tell() < part.end:
                h = header(file)
                if h is None:
                    if whole:
                        break
                    raise ValueError("an archive is cut off")
                row = self.row(file, h)
                if row is not None:
                    rows.append(row)
                if len(rows) == 256:
                    yield self.batch(rows)
                    rows = []
            if rows:
                yield self.batch(rows)

    def row(self, file, h: dict[str, str]):
        """The row of a record whose header has been read, or None if it fails a predicate; file is left behind it."""
        n, own = int(h["content-length"]), "x-payload-length" in h
        number = lambda x: int(x) if x else None
        url, kind = h.get("warc-target-uri", "").removeprefix("<").removesuffix(">"), h.get("content-type", "")
        size = number(h.get("x-payload-length")) if own else None if kind.startswith("application/http") else n
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        row = {"page_id": number(h.get("x-page-id")), "url": unquote(url) if own else url, "record_type": h.get("warc-type"), "refers_to": number(h.get("x-refers-to-page")), "payload_bytes": size, "payload_digest": digest, "payload": None}
        late = {"payload_digest"} if digest is None and self.payload else set()  # known only with the payload
        fails = any(row[name] != value for name, value in self.want if name not in late)
        if fails or not self.payload or row["record_type"] == "revisit":
            self.skip(file, n + 4)
            return None if fails else row
        block = file.read(n)
        if len(block) < n or file.read(4) not in (b"\r\n\r\n", b"\r\n", b""):
            raise ValueError(f"record {h.get('warc-record-id')} is cut off")
        if h.get("warc-block-digest", "").startswith("sha1:") and sha1(block) != h["warc-block-digest"][5:].upper():
            raise ValueError(f"record {h.get('warc-record-id')} is damaged")
        payload = payload_of(block, kind)
        if own and (len(payload) != size or sha1(payload) != digest):
            raise ValueError(f"record {h.get('warc-record-id')} is damaged")
        row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest or sha1(payload)}
        return None if any(row[name] != value for name, value in self.want) else row

    def skip(self, file, n: int) -> None:
        if isinstance(file, gzip.GzipFile):
            while n > 0 and (x := file.read(min(n, 1 << 20))):
                n -= len(x)
        else:
            file.seek(n, io.SEEK_CUR)

    def batch(self, rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))


class Written(WriterCommitMessage):
    def __init__(self, name: str, marks: list[int]):
        self.name, self.marks = name, marks


class Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.date = options["path"], options.get("date", DATE)

    def write(self, iterator):
        store, root = folder(self.path)
        store.create_dir(root, recursive=True)
        name, at, marks = f"part-{uuid.uuid4().hex}.warc", 0, [0]
        with store.open_output_stream(f"{root}/{name}") as file:
            for b in iterator:
                for r in b.to_pylist():
                    raw = record(r["page_id"], r["url"], r["record_type"], r["refers_to"], bytes(r["payload"] or b""), r["refers_to_url"], self.date)
                    file.write(raw)
                    at += len(raw)
                    if at - marks[-1] >= 1 << 20:  # places where a range may begin
                        marks.append(at)
        return Written(name, [*marks, at] if at > marks[-1] else marks)

    def commit(self, messages):
        store, root = folder(self.path)
        store.create_dir(root, recursive=True)
        done = [(m.name, m.marks) for m in messages if m is not None and m.marks[-1] > 0]
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as file:
            file.write(json.dumps(done).encode())

    def abort(self, messages):
        store, root = folder(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, salts: int = 32) -> DataFrame:
    """Records to write. A payload that many pages share is spread over `salts` keys, and summed up per task first."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    parts = rows.groupBy("digest", "n", "salt").agg(F.max(F.struct("page_id", "url")).alias("top"))
    tops = parts.groupBy("digest", "n").agg(F.max("top").alias("top")).select("digest", "n", F.col("top.page_id").alias("response"), F.col("top.url").alias("response_url"))
    found = parts.select("digest", "n", "salt").join(tops, ["digest", "n"])
    rows = rows.join(found, ["digest", "n", "salt"])
    own = F.col("page_id").eqNullSafe(F.col("response"))
    return rows.select("page_id", "url", F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("response")).alias("refers_to"), F.col("n").cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("payload_digest"), "payload", F.when(~own, F.col("response_url")).alias("refers_to_url"))


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Writes a record for each page; the folder of the archives."""
    spark = pages.sparkSession
    register(spark)
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    with_revisits(pages).write.format("warc").mode("append").option("path", path).save()
    return path


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).option("path", path).load()

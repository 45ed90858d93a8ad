"""WARC archives with a two-level capture index.

Archives: each task writes one file of gzip members, a record each. Of equal payloads (by SHA-1) the record with the
largest id is the response, the others are revisits that refer to it and hold headers only.

Index: captures are sorted by reversed-host URL key and id, range-partitioned into shards; a shard is a file of gzip
blocks of BLOCK_LINES lines and a sparse directory of its blocks' first keys. The list of shards is one line per task.
A lookup bisects the shards, the shard's directory and the block, and then reads the record's byte range.

Files are written beside their final names and renamed, under names that a retried task repeats, so a lost executor
leaves no half file behind. Folders are URIs that pyarrow's file systems open; all executors must reach them.

Defined results: null html is an empty payload; null urls are keyed by `urn:`; characters that a key can't hold are
percent-encoded; rows that repeat the id of a response and its payload are responses too; a null id refers and is
referred to as null; an empty table gives an empty table; columns other than the three named ones are not archived.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import small_batches, stored
from waymark.session import width

BLOCK_LINES, ROTATE_BYTES, LEVEL = 3000, 1 << 30, 6
#: Lines of a shard of the index, and records that a task looks up, in the mean.
SHARD_LINES, LOOKUP_ROWS = 1_000_000, 20_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "skey string, file string, offset long, length long"
SHARD = "first string, last string, file string, directory string, lines long"
FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def url_key(url: str | None) -> str:
    """Reversed host, `)`, path and query; lower-case host without www and default port."""
    if not url:
        return "urn:)"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return quote(url, safe="/:?=&,)%")
    labels = host.split(".")
    if len(labels) > 2 and labels[0].rstrip("0123456789") == "www":
        labels = labels[1:]
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    own = f":{port}" if port and port not in (80, 443) else ""
    return quote(",".join(reversed(labels)) + own + ")" + tail, safe="/:?=&,)%;+@!$*()'~-._")


def sort_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} " + ("-" if page_id is None else f"{page_id + 2**63:020d}")


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    found = (value or "").strip("<>").removeprefix("urn:page:")
    return int(found) if found.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe='/:?=&,)%;+@!$*()#~-._') if url else 'urn:'}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers)}"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    return gzip_member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC headers, payload, payload bytes as its HTTP header has it) of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return headers, payload, size


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Output:
    """A file that gets its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, top = opened(folder)
        context = TaskContext.get()
        self.path, self.own = f"{top}/{name}", f"{top}/.{name}.{context.taskAttemptId() if context else 0}"
        self.fs.create_dir(top, recursive=True)
        self.file, self.size = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> tuple[int, int]:
        at = self.size
        self.file.write(data)
        self.size += len(data)
        return at, len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.own, self.path)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; returns their captures (skey, file, offset, length), stored."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    given = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    many = given.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    many = stored(many, "warc-payloads")
    # Rows that refer to another; only they carry anything to the join with the payloads.
    refer = stored(given.select("id", "digest").join(many, "digest").where("id is null or id < top").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "top").distinct(), "warc-revisits")
    marked = given.hint("merge").join(refer, F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left").select("id", "url", "payload", F.col("rdigest").isNotNull().alias("revisit"), "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = None, 0
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for page_id, url, data, revisit, top in zip(*(c.to_pylist() for c in b.columns)):
                if out is not None and out.size >= ROTATE_BYTES:
                    out.close()
                    out, part = None, part + 1
                if out is None:
                    name = f"part-of-{TaskContext.get().partitionId():06d}-{part:04d}.warc.gz"
                    out = Output(f"{folder}/archives", name)
                at, n = out.write(record(page_id, url, data, sha1_base32(data), top, revisit))
                for r, x in zip(rows, (sort_key(url, page_id), name, at, n)):
                    r.append(x)
            yield pa.record_batch([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())], ["skey", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(marked.mapInArrow(run, ENTRY), "warc-captures")


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str, str, int]]:
    """Writes the shards and their directories; returns the list of shards in key order (a row for each task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, data, first, last, total, held, directory = f"shard-{TaskContext.get().partitionId():06d}", None, None, None, 0, [], []

        def block() -> None:
            at, n = data.write(gzip_member(("\n".join(held) + "\n").encode()))
            directory.append(f"{held[0].split(chr(9))[0]}\t{at}\t{n}")
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                data = data or Output(f"{folder}/index", f"{name}.gz")
                first, last, total = first or row[0], row[0], total + 1
                held.append("\t".join(map(str, row)))
                if len(held) == BLOCK_LINES:
                    block()
        if data is not None:
            if held:
                block()
            data.close()
            listed = Output(f"{folder}/index", f"{name}.idx")
            listed.write(("\n".join(directory) + "\n").encode())
            listed.close()
        rows = [(first, last, f"{name}.gz", f"{name}.idx", total)] if total else []
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string()] * 4 + [pa.int64()])], ["first", "last", "file", "directory", "lines"])

    n = captures.count()
    few = max(1, min(width(captures.sparkSession), n // BLOCK_LINES), -(-n // SHARD_LINES))
    parts = captures.repartitionByRange(few, "skey").sortWithinPartitions("skey")
    return sorted(tuple(r) for r in stored(parts.mapInArrow(run, SHARD), "warc-shards").collect())


class Reader:
    """Looks captures up; keeps a few directories, blocks and open files."""

    def __init__(self, folder: str, shards: list[tuple[str, str, str, str, int]], keep: int = 8):
        self.fs, self.top = opened(folder)
        self.shards, self.keep = shards, keep
        self.firsts = [s[0] for s in shards]
        self.kept: dict[str, OrderedDict] = {k: OrderedDict() for k in ("directory", "block", "file")}

    def _once(self, kind: str, key, make):
        held = self.kept[kind]
        if key in held:
            held.move_to_end(key)
            return held[key]
        held[key] = make()
        if len(held) > self.keep:
            _, old = held.popitem(last=False)
            if kind == "file":
                old.close()
        return held[key]

    def _range(self, path: str, at: int, n: int) -> bytes:
        f = self._once("file", path, lambda: self.fs.open_input_file(f"{self.top}/{path}"))
        return f.read_at(n, at)

    def _directory(self, shard: int) -> tuple[list[str], list[tuple[int, int]]]:
        def load():
            with self.fs.open_input_stream(f"{self.top}/index/{self.shards[shard][3]}", compression=None) as f:
                rows = [x.split("\t") for x in f.read().decode().splitlines()]
            return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

        return self._once("directory", shard, load)

    def _block(self, shard: int, k: int) -> tuple[list[str], list[str]]:
        def load():
            at, n = self._directory(shard)[1][k]
            lines = gzip.decompress(self._range(f"index/{self.shards[shard][2]}", at, n)).decode().splitlines()
            return [x.split("\t", 1)[0] for x in lines], lines

        return self._once("block", (shard, k), load)

    def captures(self, key: str) -> Iterator[tuple[str, str, int, int]]:
        """Index lines whose sort key begins with key, in order."""
        s = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while s < len(self.shards) and (self.firsts[s] <= key or self.firsts[s].startswith(key)):
            firsts = self._directory(s)[0]
            k = max(0, bisect.bisect_left(firsts, key) - 1)
            while k < len(firsts) and (firsts[k] <= key or firsts[k].startswith(key)):
                keys, lines = self._block(s, k)
                for i in range(bisect.bisect_left(keys, key), len(keys)):
                    if not keys[i].startswith(key):
                        return
                    skey, file, at, n = lines[i].split("\t")
                    yield skey, file, int(at), int(n)
                k += 1
            s += 1

    def record(self, file: str, at: int, n: int) -> tuple[dict[str, str], bytes, int]:
        return parse(self._range(f"archives/{file}", at, n))


def lookup(wanted: DataFrame, folder: str, shards: list[tuple[str, str, str, str, int]], id_col: str = "page_id", url_col: str = "url", with_payload: bool = True) -> DataFrame:
    """The record of each wanted (id, url), read through the index; of repeated ones each gets the first."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([sort_key(u, i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], ["skey"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, shards)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            rows = []
            for key in b.column(0).to_pylist():
                found = next(reader.captures(key), None)
                if found is None:
                    raise KeyError(f"no capture of {key}")
                headers, payload, size = reader.record(*found[1:])
                digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                if kind == "response" and sha1_base32(payload) != digest:
                    raise ValueError(f"{found[1]} at {found[2]}: the payload does not have its digest")
                rows.append((page_of(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, kind, page_of(headers.get("warc-refers-to")), payload if with_payload else None))
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    small_batches(wanted.sparkSession)
    keys = stored(wanted.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).mapInArrow(keyed, "skey string"), "warc-wanted")
    # A fixed number of parts by the records' bytes: the keys alone would be merged to one task.
    parts = max(width(wanted.sparkSession), -(-sum(s[4] for s in shards) // LOOKUP_ROWS))
    return keys.repartitionByRange(parts, "skey").sortWithinPartitions("skey").mapInArrow(run, FOUND)

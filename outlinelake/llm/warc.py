"""WARC archives and the external merge of their capture indexes (operator 4).

write() deals pages over tasks; each writes gzip-member WARC archives to the shared folder and gives a capture run: an
index entry per record, sorted locally by URL key and timestamp. merge() makes one globally ordered capture history:
entries are dealt by ranges of (key, timestamp, run, place) with sampled splitters, and each task merges its slices of
all runs with a loser tree. read() opens archives at the offsets of the index and takes every value from the records.

Of payloads that are equal and have at least `least` bytes, the page with the smallest page_id is a response and the
others are revisit records, which have the HTTP header but no payload.

Defined results: null html counts as empty; null urls have an empty key and target. A null page_id is written as an
empty field and read back as null; it is the original only where no other page has the payload. Repeated rows are
records of their own, the first in input order being the original. Payloads of any length are written whole. Extra
columns are ignored; an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, numbered, scan_parts, scratch, tidied
from .side_files import put

ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN = pa.schema([("run", pa.string()), ("place", pa.int64()), ("key", pa.string()), ("stamp", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("kind", pa.string())])
RUN_SCHEMA = "run string, place long, key string, stamp string, uri string, offset long, length long, digest string, kind string"


def url_key(url: str) -> str:
    """The URL with its host's labels turned round, in lower case, without scheme, default port, fragment."""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    at = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{at}){u.path.lower() or '/'}" + (f"?{u.query.lower()}" if u.query else "")


def record(rid: int, page_id: int | None, url: str, html: bytes, digest: str, seconds: int, original: tuple[int | None, int] | None) -> tuple[bytes, str, str]:
    """One WARC record, its timestamp and its kind. original: page_id and row number of the response that a revisit refers to."""
    when = datetime.fromtimestamp(seconds, UTC)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    kind, block = ("revisit", http) if original else ("response", http + html)
    shown = lambda x: "" if x is None else x
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(int=rid)}>", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-Id: {shown(page_id)}",
    ]
    if original:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.UUID(int=original[1])}>", f"X-Refers-To-Page-Id: {shown(original[0])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", f"{when:%Y%m%d%H%M%S}", kind


def parse(raw: bytes) -> dict:
    """Headers, kind, payload and the payload's stated length of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"headers": headers, "kind": headers["warc-type"], "payload": payload, "stated": stated}


@tidied
def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k, held, size, entries = TaskContext.get().partitionId(), 0, [], 0, []

    def close():
        nonlocal k, held, size, entries
        name = f"{part:06d}-{k:05d}-{uuid.uuid4().hex[:8]}"
        uri = put(folder, f"{name}.warc.gz", b"".join(held))
        entries.sort()
        run = pa.RecordBatch.from_pylist([{"run": name, "place": i, "key": e[0], "stamp": e[1], "uri": uri, "offset": e[2], "length": e[3], "digest": e[4], "kind": e[5]} for i, e in enumerate(entries)], schema=RUN)
        k, held, size, entries = k + 1, [], 0, []
        return run

    for b in batches:
        for rid, page_id, url, html, digest, seconds, revisit, of_page, of_rid in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw, stamp, kind = record(rid, page_id, url, html, digest, seconds, (of_page, of_rid) if revisit else None)
            z = zlib.compressobj(4, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            entries.append((url_key(url), stamp, size, len(member), digest, kind))
            held.append(member)
            size += len(member)
            if size >= ARCHIVE_BYTES:
                yield close()
    if held:
        yield close()


def captured() -> Column:
    """Seconds since 1970 at which a page counts as captured where the table has no time: its page_id after a fixed day."""
    return F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9))


def write(pages: DataFrame, least: int = 100, seconds: Column | None = None) -> DataFrame:
    """Write the archives; their capture runs, each sorted by key and timestamp."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = numbered(bounded(pages)).select("rid", F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"), (captured() if seconds is None else seconds).cast("long").alias("seconds"))
    keys = materialise(rows.where(F.octet_length("html") >= least).select("rid", "page_id", "digest"), "payloads")
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), F.col("page_id").alias("of_page"), F.col("rid").alias("of_rid")))
    firsts = materialise(keys.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first.of_page", "first.of_rid"), "originals")
    revisits = materialise(keys.join(firsts, "digest").where("rid <> of_rid").select(F.col("rid").alias("re_rid"), "of_page", "of_rid"), "revisits")
    joined = rows.join(revisits, F.col("rid") == F.col("re_rid"), "left")
    out = joined.select("rid", "page_id", "url", "html", "digest", "seconds", F.col("re_rid").isNotNull().alias("revisit"), "of_page", "of_rid")
    return materialise(out.mapInArrow(partial(_write, scratch(pages.sparkSession, "archives")), RUN_SCHEMA), "capture-runs")


class LoserTree:
    """Merges k sorted iterators: each inner node holds the loser of its match, node 0 the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self.replay(leaf)

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self.before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        while self.k:
            w = self.tree[0]
            if self.heads[w] is None:
                return
            yield self.heads[w], w
            self.heads[w] = next(self.runs[w], None)
            self.replay(w)


@tidied
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)  # one range of the index; its size is set by the number of ranges
    if not held:
        return
    t = pa.Table.from_batches(held)
    runs: dict[str, list[tuple]] = {}
    for i, (run, place, key, stamp) in enumerate(zip(*(t[c].to_pylist() for c in ("run", "place", "key", "stamp")), strict=True)):
        runs.setdefault(run, []).append((key, stamp, run, place, i))
    order = [entry[4] for entry, _ in LoserTree([iter(r) for r in runs.values()])]
    part = TaskContext.get().partitionId()
    t = t.take(pa.array(order, pa.int64()))
    t = t.append_column("part", pa.array([part] * len(order), pa.int32())).append_column("at", pa.array(range(len(order)), pa.int64()))
    yield from t.to_batches(max_chunksize=10_000)


def merge(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The capture history: all runs' entries; (part, at) is their order by key, timestamp, run, place."""
    n = ranges or max(1, min(scan_parts(runs), -(-runs.count() // 50_000)))
    dealt = runs.repartitionByRange(n, "key", "stamp", "run", "place").sortWithinPartitions("run", "place")
    return materialise(dealt.mapInArrow(_merge, RUN_SCHEMA + ", part int, at long"), "captures")


@tidied
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uri, f = None, None
    for b in batches:
        out = []
        for to, offset, length in zip(*(b.column(c).to_pylist() for c in ("uri", "offset", "length")), strict=True):
            if to != uri:
                store, path = pafs.FileSystem.from_uri(to)
                uri, f = to, store.open_input_file(path)
            f.seek(offset)
            r = parse(zlib.decompress(f.read(length), 31))
            h, whole = r["headers"], r["kind"] == "response"
            digest = h["warc-payload-digest"].removeprefix("sha256:")
            if whole and (len(r["payload"]) != r["stated"] or hashlib.sha256(r["payload"]).hexdigest() != digest):
                raise ValueError(f"a damaged record at {offset} in {to}")
            number = lambda x: int(x) if x else None
            out.append({"page_id": number(h["x-page-id"]), "payload_bytes": r["stated"], "payload_digest": digest, "record_type": r["kind"], "refers_to": number(h.get("x-refers-to-page-id")), "url": h["warc-target-uri"]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]))


def read(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record that the index names, an archive's records in one pass."""
    dealt = captures.select("uri", "offset", "length").repartition(scan_parts(captures) * 4, "uri").sortWithinPartitions("uri", "offset")
    return dealt.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


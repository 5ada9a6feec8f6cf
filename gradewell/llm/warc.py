"""WARC archives with revisit records, and their capture index by external merge.

Writing: pages are told apart by the SHA-1 and length of their payload; the smallest
page_id of equal payloads is a response, the others become revisit records that
refer to it (payloads shorter than ``min_bytes`` are always responses). Each task
writes gzip members, one a record, into archives of at most about
``ARCHIVE_BYTES`` and hands on one index run an archive: its captures sorted by
URL key and time.

Index: the runs are dealt by ranges of (URL key, time, page_id), so a URL with very
many captures is cut by time, and in every range a loser tree merges the sorted
runs: one comparison a level for each capture taken out, whatever the number
of runs. The ranges follow each other, so the whole index is in capture order.

Reading back: archives named by the index are read member by member. Files
carry a random name of the task attempt, and only attempts that succeeded reach
the index, so lost executors leave unused files but no half-read archive. The
folder is any that pyarrow's file systems reach from all executors.

Nulls and ties: a null payload is empty; a null URL is written as "about:none";
a null page_id is a response and refers to nothing. Rows that repeat the
smallest page_id of their payload are all responses. Captures without a time column are dated
2000-01-01 plus page_id seconds (null: 2000-01-01). Other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from datetime import datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm import blocks as B

ARCHIVE_BYTES = 64 << 20
RANGE_ROWS = 20_000
CELL_PAGES = 500_000      # of all pages, in a cell of those that share a payload
EPOCH = datetime(2000, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("urlkey string, captured string, page_id long, file string, offset long, length long, digest string, "
         "record_type string, refers_to long")
_FIELDS = [f.split()[0] for f in INDEX.split(", ")]


def url_key(url: str | None) -> str:
    """Sort-friendly form: host parts reversed, path, query; no scheme, user, default port, www or fragment."""
    if not url:
        return "none)/"
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return "bad)/" + url.lower()
    host = host[4:] if host.startswith("www.") else host
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")"
    return key + (p.path or "/").lower() + (f"?{'&'.join(sorted(p.query.lower().split('&')))}" if p.query else "")


def _record(page_id, url, when: str, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {when}",
            f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]') if url else 'about:none'}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[:int(h["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))

    def page(x):
        v = x[len("<urn:x-page:"):-1] if x else "None"
        return None if v == "None" else int(v)
    return {"page_id": page(h["WARC-Record-ID"]), "record_type": h["WARC-Type"], "refers_to": page(h.get("WARC-Refers-To")),
            "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": size,
            "payload": payload if h["WARC-Type"] == "response" else None, "url": h["WARC-Target-URI"], "date": h["WARC-Date"]}


def _writer(folder: str, archive_bytes: int):
    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, at, run, name = None, 0, [], ""

        def done():
            run.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
            cols = list(zip(*run))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if f in ("urlkey", "captured", "file", "digest", "record_type") else pa.int64())
                 for f, c in zip(_FIELDS, cols)], names=_FIELDS)
        for t in batches:
            for lo in range(0, t.num_rows, 256):
                part = t.slice(lo, 256)
                for page, url, html, sha, when, first in zip(*(part.column(c).to_pylist() for c in (
                        "page_id", "url", "payload", "sha", "captured", "first"))):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, at, run = store.open_output_stream(f"{root}/{name}", compression=None), 0, []
                    when = when or (EPOCH + timedelta(seconds=(page or 0) % (1 << 32))).strftime("%Y-%m-%dT%H:%M:%SZ")
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    refers = first if first is not None and page is not None and first != page else None
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    gz = z.compress(_record(page, url, when, html.encode(), digest, refers)) + z.flush()
                    out.write(gz)
                    run.append((url_key(url), when, page, f"{folder}/{name}", at, len(gz), digest,
                                "response" if refers is None else "revisit", refers))
                    at += len(gz)
                    if at >= archive_bytes:
                        out.close()
                        out = None
                        yield done()
        if out is not None:
            out.close()
            yield done()
    return write


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", time_col: str | None = None, min_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; returns the index runs, one row a capture."""
    folder = folder or B.shared_folder(pages, "warc")
    folder = B.store_uri(pages, folder)
    when = F.date_format(F.col(time_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.lit(None).cast("string")
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).alias("payload"), when.alias("captured"))
    d = d.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    marks = d.select("page_id", "sha", F.octet_length("payload").alias("bytes")).filter(
        (F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
    # a payload many pages hold meets its first page in cells of its pages, not in one task
    cells = pages.count() // CELL_PAGES + 1
    marks = marks.withColumn("cell", F.pmod(F.xxhash64("page_id"), F.lit(cells)))
    held = marks.groupBy("sha", "bytes", "cell").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("m"))
    groups = held.groupBy("sha", "bytes").agg(F.min("least").alias("first"), F.sum("m").alias("m")).filter("m > 1")
    firsts = held.select("sha", "bytes", "cell").join(groups, ["sha", "bytes"]).drop("m")
    again = marks.join(firsts, ["sha", "bytes", "cell"]).filter(F.col("page_id") != F.col("first")).select(
        F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "first").distinct()
    d = d.join(again, (d["page_id"] == again["_page"]) & (d["sha"] == again["_sha"]), "left").select(
        "page_id", "url", "payload", "sha", "captured", "first")
    return B.checkpointed(d.mapInArrow(_writer(folder, archive_bytes), INDEX))


class LoserTree:
    """k-way merge of sorted lists: inner nodes keep the losers of their
    matches, so taking the winner replays one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.head = [self._key(r) for r in range(self.k)]
        self.loser = [-1] * self.k
        winner = [0] * (2 * self.k)
        for i in range(2 * self.k - 1, 0, -1):
            if i >= self.k:
                winner[i] = i - self.k
            else:
                a, b = winner[2 * i], winner[2 * i + 1]
                a, b = (a, b) if self._less(a, b) else (b, a)
                winner[i], self.loser[i] = a, b
        self.best = winner[1] if self.k > 1 else 0

    def _key(self, r: int):
        return self.key(self.runs[r][self.at[r]]) if r < len(self.runs) and self.at[r] < len(self.runs[r]) else None

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def __iter__(self):
        while self.head[self.best] is not None:
            r = self.best
            yield self.runs[r][self.at[r]]
            self.at[r] += 1
            self.head[r] = self._key(r)
            i = (r + self.k) // 2
            while i:
                if self._less(self.loser[i], r):
                    self.loser[i], r = r, self.loser[i]
                i //= 2
            self.best = r


def _capture(row: dict):
    return row["urlkey"], row["captured"], row["page_id"] is None, row["page_id"] or 0, row["file"], row["offset"]


def _merge(batches):
    """The captures of one key range, merged from the runs that reach into it."""
    runs: dict[str, list[dict]] = {}
    for t in batches:
        for row in t.to_pylist():
            runs.setdefault(row["file"], []).append(row)
    for rows in runs.values():
        # the exchange may deliver a run's rows in pieces out of order: whole again, it is sorted as written
        if any(_capture(a) > _capture(b) for a, b in zip(rows, rows[1:])):
            rows.sort(key=_capture)
    batch: list[dict] = []
    for row in LoserTree([runs[f] for f in sorted(runs)], _capture):
        batch.append(row)
        if len(batch) == 5000:
            yield pa.RecordBatch.from_pylist(batch, schema=_SCHEMA)
            batch = []
    if batch:
        yield pa.RecordBatch.from_pylist(batch, schema=_SCHEMA)


_SCHEMA = pa.schema([(f, pa.string() if f in ("urlkey", "captured", "file", "digest", "record_type") else pa.int64())
                     for f in _FIELDS])


def merged_index(runs: DataFrame) -> DataFrame:
    """The whole index in the order (URL key, time, page_id): partitions are consecutive ranges."""
    n = runs.count() // RANGE_ROWS + 1
    return runs.repartitionByRange(n, F.col("urlkey"), F.col("captured"), F.col("page_id").asc_nulls_last()).mapInArrow(
        _merge, INDEX)


def _members(stream, chunk: int = 1 << 20):
    """(offset, bytes) of every gzip member of a stream."""
    offset, z, out, used, data = 0, zlib.decompressobj(31), [], 0, b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                return
        out.append(z.decompress(data))
        used += len(data) - len(z.unused_data)
        data = z.unused_data
        if z.eof:
            yield offset, b"".join(out)
            offset, z, out, used = offset + used, zlib.decompressobj(31), [], 0


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the archives an index names: (file, offset, page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, intact); intact: a response's payload has its digest and length."""
    def read(batches):
        import hashlib
        for t in batches:
            for file in t.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                rows = []
                with store.open_input_stream(path, compression=None) as f:
                    for offset, raw in _members(f):
                        r = parse_record(raw)
                        body = r.pop("payload")
                        r["intact"] = body is None or (len(body) == r["payload_bytes"] and base64.b32encode(
                            hashlib.sha1(body).digest()).decode() == r["payload_digest"])
                        rows.append(r | {"file": file, "offset": offset})
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
    text = ("file", "url", "record_type", "payload_digest")
    names = ["file", "offset", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    schema = pa.schema([(c, pa.string() if c in text else pa.int64()) for c in names] + [("intact", pa.bool_())])
    files = index.select("file").distinct()
    # a fixed number of partitions: the list of names is tiny, what stands behind a name is not
    return files.repartition(max(1, files.count()), "file").mapInArrow(read, "file string, offset long, page_id long, url string, record_type string, "
                                  "refers_to long, payload_digest string, payload_bytes long, intact boolean")


def read_capture(row) -> dict:
    """One record by its index row: a single seek."""
    store, path = fs.FileSystem.from_uri(row["file"])
    with store.open_input_file(path) as f:
        f.seek(row["offset"])
        return parse_record(zlib.decompress(f.read(row["length"]), 31))

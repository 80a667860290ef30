"""WARC archives and a two-level capture index over them.

Writing: tasks write archive files of WARC/1.1 records (response or revisit), each a
gzip member of its own as usual in WARC files, into the shared folder, a new file for each attempt; only what a finished attempt reports is
ever referred to. Of records with equal payloads of REVISIT_BYTES or more, the one
with the largest id is the response; the others are revisits that refer to it and hold
its HTTP header (with the payload's length and digest) but no payload.

Index: captures sorted by reversed-host URL key and id are written as compressed
blocks of BLOCK_ROWS lines; a sparse directory has one row per block (its first key and
place). A lookup binary-searches the directory, reads one block's byte range, binary-
searches its lines, then reads one record's byte range from its archive. The directory
is broadcast in slices of at most SLICE blocks, so its size in a task is bounded.

Files are reached through pyarrow's file systems, so the shared folder may be any
store that those know. Defined results: a NULL html is an empty payload, a NULL url an
empty key. Rows that repeat an id are records of their own; those with the largest id
of equal payloads are all responses. A NULL id is smaller than any other.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.session import cut, scratch_path
from plumbline.llm.common import map_batches, parts, utf8

REVISIT_BYTES = 1000
BLOCK_ROWS = 512
SLICE = 200_000
#: zlib level of an archive's records, and the window bits that stand for gzip
_LEVEL, _GZIP = 1, 31
_DATE = "2024-01-01T00:00:00Z"
_URL = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^#]*)", re.S)


def url_key(url: str) -> str:
    """Reversed host, then path and query: http://www.a.org/x?y becomes org,a,www)/x?y."""
    match = _URL.match(url or "")
    host = ",".join(reversed(match[2].lower().split("."))) if match[2] else ""
    port = f":{match[3]}" if match[3] not in (None, "", "80", "443") else ""
    return f"{host}{port}){match[4] or '/'}" if host else (url or "")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:/") else f"file://{path}")


def record(row_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{row_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record's fields; fails if lengths or the payload's digest don't fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if lines[0] != "WARC/1.1" or len(block) != int(fields["Content-Length"]):
        raise ValueError("not a whole WARC record")
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")

    def number(field: str) -> int | None:
        text = fields.get(field, "<urn:page:None>").removeprefix("<urn:page:").removesuffix(">")
        return None if text == "None" else int(text)

    return {"id": number("WARC-Record-ID"), "bytes": length, "digest": digest, "type": kind, "refers_to": number("WARC-Refers-To") if kind == "revisit" else None, "payload": payload}


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, key, file, offset, length) of every record written below `folder`. Evaluate it once: cut() does."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), utf8(F.col(html)).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    shared = (
        rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("digest").alias("d"), "first")
    )
    typed = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("size") >= REVISIT_BYTES), "left")
    typed = typed.withColumn("revisit", F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))

    def run(batches):
        name = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz"
        system, path = _open(name)
        system.create_dir(path.rsplit("/", 1)[0])
        at = 0
        with system.open_output_stream(path, compression=None) as out:
            for b in batches:
                done = {"id": b["id"], "key": [], "file": [name] * len(b["id"]), "offset": [], "length": []}
                for i, u, p, d, first, again in zip(b["id"], b["url"], b["payload"], b["digest"], b["first"], b["revisit"]):
                    raw = zlib.compress(record(i, u, p, d, first, again), _LEVEL, _GZIP)
                    out.write(raw)
                    done["key"].append(url_key(u))
                    done["offset"].append(at)
                    done["length"].append(len(raw))
                    at += len(raw)
                yield done

    return map_batches(typed.select("id", "url", "payload", "digest", "first", "revisit"), run, "id bigint, key string, file string, offset bigint, length bigint")


def _place(key: str, row_id: int | None) -> tuple[str, int, int]:
    return (key, row_id is not None, row_id or 0)


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """The directory: (key, id, file, offset, length) of each block's first line and bytes. Evaluate it once."""
    spark = captures.sparkSession
    ordered = captures.repartitionByRange(parts(spark), F.col("key"), F.col("id").asc_nulls_first(), "offset").sortWithinPartitions("key", F.col("id").asc_nulls_first(), "file", "offset")

    def run(batches):
        name = f"{folder}/index-{uuid.uuid4().hex}.cdx"
        system, path = _open(name)
        system.create_dir(path.rsplit("/", 1)[0])
        at, lines = 0, []
        with system.open_output_stream(path) as out:

            def close() -> dict[str, list]:
                nonlocal at, lines
                raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
                out.write(raw)
                row = {"key": [lines[0][0]], "id": [lines[0][1]], "file": [name], "offset": [at], "length": [len(raw)]}
                at, lines = at + len(raw), []
                return row

            for b in batches:
                for line in zip(b["key"], b["id"], b["file"], b["offset"], b["length"]):
                    lines.append(line)
                    if len(lines) == BLOCK_ROWS:
                        yield close()
            if lines:
                yield close()

    return map_batches(ordered.select("key", "id", "file", "offset", "length"), run, "key string, id bigint, file string, offset bigint, length bigint")


class _Files:
    """Open files of a task, a few at a time."""

    def __init__(self):
        self.open: dict[str, object] = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 32:
                self.open.pop(next(iter(self.open))).close()
            system, path = _open(name)
            self.open[name] = system.open_input_file(path)
        file = self.open[name]
        file.seek(offset)
        return file.read(length)


def _search(wanted: tuple[str, int, int], starts: list[tuple[str, int, int]], blocks: list[tuple], files: _Files, kept: dict[int, list]) -> Iterator[tuple]:
    """Captures (file, offset, length) with the wanted key and id: the last block that starts before it, and on."""
    at = max(0, bisect.bisect_left(starts, wanted) - 1)
    while at < len(blocks) and starts[at] <= wanted:
        if at not in kept:
            if len(kept) >= 8:
                kept.pop(next(iter(kept)))
            kept[at] = [json.loads(x) for x in zlib.decompress(files.read(*blocks[at])).decode().split("\n")]
        lines = kept[at]
        i = bisect.bisect_left(lines, wanted, key=lambda x: _place(x[0], x[1]))
        while i < len(lines) and _place(lines[i][0], lines[i][1]) == wanted:
            yield tuple(lines[i][2:])
            i += 1
        at += 1


def lookup(directory: DataFrame, wanted: DataFrame, slice_blocks: int = SLICE) -> DataFrame:
    """The records of the wanted (key, id) pairs, as `parse` gives them (without payload) and the key.

    `directory` is a stored table. Wanted pairs should be distinct; each record with a pair is returned.
    """
    spark = directory.sparkSession
    smaller_first = F.col("id").asc_nulls_first()
    wanted = wanted.repartitionByRange(parts(spark), "key", smaller_first).sortWithinPartitions("key", smaller_first)
    if directory.count() <= slice_blocks:
        return _lookup(directory, wanted)
    # each index file is a range of keys of its own; a slice is as many files as fit
    out, files, size = None, [], 0
    per_file = directory.groupBy("file").agg(F.min(F.struct("key", "id")).alias("at"), F.count("*").alias("n")).orderBy("at").collect()
    for row in [*per_file, None]:
        if files and (row is None or size + row["n"] > slice_blocks):
            one = _lookup(directory.where(F.col("file").isin(files)), wanted)
            out = one if out is None else out.unionByName(one)
            files, size = [], 0
        if row is not None:
            files, size = [*files, row["file"]], size + row["n"]
    return out


def _lookup(directory: DataFrame, wanted: DataFrame) -> DataFrame:
    spark = wanted.sparkSession
    rows = sorted(directory.collect(), key=lambda r: (_place(r["key"], r["id"]), r["file"], r["offset"]))
    shared = spark.sparkContext.broadcast(([_place(r["key"], r["id"]) for r in rows], [(r["file"], r["offset"], r["length"]) for r in rows]))

    def run(batches):
        starts, blocks = shared.value
        files, kept = _Files(), {}
        for b in batches:
            out = {c: [] for c in ("key", "id", "bytes", "digest", "type", "refers_to")}
            for key, row_id in zip(b["key"], b["id"]):
                for file, offset, length in _search(_place(key, row_id), starts, blocks, files, kept):
                    got = parse(zlib.decompress(files.read(file, offset, length), _GZIP))
                    out["key"].append(key)
                    for c in ("id", "bytes", "digest", "type", "refers_to"):
                        out[c].append(got[c])
            yield out

    return map_batches(wanted.select("key", "id"), run, "key string, id bigint, bytes bigint, digest string, type string, refers_to bigint")


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives and index of `pages`, then look every capture up and read it back."""
    folder = scratch_path(pages.sparkSession, "warc")
    captures = cut(write_archives(pages, folder, key, url, html))
    directory = cut(build_index(captures, folder))
    return lookup(directory, captures.select("key", "id").distinct())

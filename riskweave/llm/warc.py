"""Web archives: one WARC record per page, written by the tasks into the shared folder, found again through a
two-level capture index.

1. Payloads (the html as UTF-8, null: empty) are digested with SHA-1 by a built-in function. Of pages with equal payloads
   of at least ``SMALL_PAYLOAD`` bytes, the one with the largest page_id becomes a ``response`` record and every other one a
   ``revisit`` that refers to it (identical-payload-digest profile, no payload of its own). Smaller payloads are always
   responses. Which page is the response comes from a grouping that combines map-side; it reaches the pages by a join
   whose hot digests are salted (``balanced_lookup``), so one payload held by a third of all pages costs no single task.
2. Each task writes its records, sorted by page_id, as one ``.warc.gz`` file of gzip members (one per record) and gives
   back a capture line per record: the reversed-host URL key (SURT), page_id, file, offset and length. Files are named
   by the task's partition, so a task that runs again after a lost executor writes the same file.
3. Capture lines are sorted by (key, page_id) over range partitions. Each partition cuts its lines into blocks of
   ``BLOCK_LINES``, compresses each block as a gzip member of one cluster file, and states the block's first key, offset and
   length: the sparse block directory.
4. Reading back: the first key of each cluster file (one row per partition) is the top level; a binary search there
   names the cluster file, a second one in that file's directory names the block. Lookups of a file meet its directory in
   a cogroup; each block is read by its byte range, unpacked and searched. The records are then read by their byte range
   and parsed; a revisit's payload length and page come from the response it refers to.

Defined results: a null html is an empty payload; a null url has key ``-``; a null page_id never becomes the response of a
group that has other ids, and is a response if its group has none; repeated rows are written, indexed and read back
once each; other columns are not carried."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, send_by_value, shuffle_width
from .common import balanced_lookup, stored

#: Payloads below this many bytes are never replaced by revisits.
SMALL_PAYLOAD = 1000
#: Capture lines per compressed block of the index.
BLOCK_LINES = 1000
#: The capture time written into records and lines (the table has none).
CAPTURE_TIME = "20260101000000"
_DATE = "2026-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1b7d52-8a0c-4f7e-9d57-1c3b2a4e5f60")
_INDEX = "key string, page_id long, file string, offset long, length long, record_type string, digest string"

send_by_value(__name__)


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: ``com,example,m)/path?query``, lower case, without scheme, www, port or fragment."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.strip().lower()
    if host.startswith("www."):
        host = host[4:]
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){path.lower()}"


def _id(page_id) -> str:
    return "-" if page_id is None or pd.isna(page_id) else str(int(page_id))


def record_id(page_id, url, digest) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{_id(page_id)}|{url}|{digest}')}>"


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _hex(b32_digest: str) -> str:
    return base64.b32decode(b32_digest).hex()


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder (local, HDFS, object stores: whatever pyarrow reaches) and the folder, made."""
    filesystem, root = fs.FileSystem.from_uri(uri)
    filesystem.create_dir(root, recursive=True)
    return filesystem, root


def warc_record(row, payload: bytes) -> bytes:
    """One gzip member holding a WARC/1.1 response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    block = http + (payload if row.record_type == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {row.record_type}",
        f"WARC-Record-ID: {record_id(row.page_id, row.url, row.digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {'' if row.url is None else row.url}",
        f"WARC-Payload-Digest: sha1:{_b32(row.digest)}",
    ]
    if row.record_type == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(row.refers_to, row.refers_url, row.digest)}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers and payload of one record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"fields": fields, "http": http_fields, "payload": payload}


def records(pages: DataFrame) -> DataFrame:
    """Pages with payload size, SHA-1, record type and the page they revisit."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    big = F.col("payload_bytes") >= SMALL_PAYLOAD
    heads = p.where(big).groupBy("digest").agg(
        F.max(F.struct("page_id", "url")).alias("head"), F.count(F.lit(1)).alias("rows")
    )
    heads = heads.select("digest", "rows", F.col("head.page_id").alias("head_id"), F.col("head.url").alias("head_url"))
    met = balanced_lookup(p.where(big), heads, "digest", "rows", ["page_id", "url"])
    revisit = met["head_id"].isNotNull() & (met["page_id"].isNull() | (met["page_id"] < met["head_id"]))
    big_rows = met.select(
        "page_id", "url", "payload", "digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("head_id")).alias("refers_to"),
        F.when(revisit, F.col("head_url")).alias("refers_url"),
    )
    small = p.where(~big).select(
        "page_id", "url", "payload", "digest", "payload_bytes", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"),
    )
    return big_rows.unionByName(small)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write each partition's records as one WARC file; the capture lines of all of them, stored."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = _filesystem(folder)
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        out, offset = None, 0
        for rows in batches:
            if out is None:
                out = filesystem.open_output_stream(f"{root}/{name}.tmp")
            lines = []
            for row in rows.itertuples(index=False):
                member = warc_record(row, row.payload)
                out.write(member)
                lines.append((surt(row.url), row.page_id, name, offset, len(member), row.record_type, row.digest))
                offset += len(member)
            yield pd.DataFrame(lines, columns=["key", "page_id", "file", "offset", "length", "record_type", "digest"]).astype(
                {"page_id": "Int64", "offset": "int64", "length": "int64"}
            )
        if out is not None:
            out.close()
            filesystem.move(f"{root}/{name}.tmp", f"{root}/{name}")

    ordered = records(pages).sortWithinPartitions("page_id", "digest", "url")
    return stored(ordered.mapInPandas(write, _INDEX))


def capture_index(lines: DataFrame, folder: str) -> DataFrame:
    """Sort capture lines by key and page, pack them into compressed blocks, and give the sparse block directory."""
    width = shuffle_width(lines.sparkSession)
    ordered = lines.repartitionByRange(width, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = _filesystem(folder)
        name = f"cdx-{TaskContext.get().partitionId():05d}.gz"
        out, offset, waiting = None, 0, []

        def block(rows: pd.DataFrame) -> tuple:
            nonlocal offset
            text = "".join(
                f"{r.key.replace(' ', '%20')} {CAPTURE_TIME} {'-' if pd.isna(r.page_id) else int(r.page_id)} "
                f"{r.record_type} {r.digest} {int(r.length)} {int(r.offset)} {r.file}\n"
                for r in rows.itertuples(index=False)
            )
            member = gzip.compress(text.encode(), mtime=0)
            out.write(member)
            head = rows.iloc[0]
            entry = (head.key, None if pd.isna(head.page_id) else int(head.page_id), name, offset, len(member), len(rows))
            offset += len(member)
            return entry

        def directory(entries: list) -> pd.DataFrame:
            return pd.DataFrame(entries, columns=["first_key", "first_page", "cluster", "offset", "length", "lines"]).astype(
                {"first_page": "Int64", "offset": "int64", "length": "int64", "lines": "int64"}
            )

        for rows in batches:
            if out is None and len(rows):
                out = filesystem.open_output_stream(f"{root}/{name}.tmp")
            waiting.append(rows)
            pending = pd.concat(waiting, ignore_index=True)
            full = len(pending) // BLOCK_LINES * BLOCK_LINES
            yield directory([block(pending.iloc[k : k + BLOCK_LINES]) for k in range(0, full, BLOCK_LINES)])
            waiting = [pending.iloc[full:]]
        if out is not None:
            rest = pd.concat(waiting, ignore_index=True)
            yield directory([block(rest)] if len(rest) else [])
            out.close()
            filesystem.move(f"{root}/{name}.tmp", f"{root}/{name}")

    schema = "first_key string, first_page long, cluster string, offset long, length long, lines long"
    return stored(ordered.mapInPandas(pack, schema))


def _order(key, page) -> tuple:
    """Sort order of capture lines: key, then page_id with nulls first."""
    return (key, page is not None and not pd.isna(page), -1 if page is None or pd.isna(page) else int(page))


def lookup(queries: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """The capture lines of (key, page_id) queries, by binary search in the two levels and range reads of blocks."""
    firsts = directory.where(F.col("offset") == 0).select("cluster", "first_key", "first_page").collect()
    tops = sorted((_order(r.first_key, r.first_page), r.cluster) for r in firsts)
    keys, clusters = [k for k, _ in tops], [c for _, c in tops]

    def top_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [max(bisect.bisect_right(keys, _order(k, p)) - 1, 0) for k, p in zip(b["key"], b["page_id"], strict=True)]
            yield b.assign(cluster=[clusters[i] if clusters else None for i in at])

    named = queries.mapInPandas(top_level, "key string, page_id long, cluster string")

    def second_level(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or blocks.empty:
            return pd.DataFrame([], columns=_INDEX.replace(" string", "").replace(" long", "").split(", "))
        filesystem, root = _filesystem(folder)
        blocks = blocks.sort_values("offset").reset_index(drop=True)
        firsts = [_order(k, p) for k, p in zip(blocks["first_key"], blocks["first_page"], strict=True)]
        # Equal lines may straddle blocks: a query is looked for from the last block that starts below it
        # through the last block that starts at or below it.
        by_block: dict[int, set] = {}
        for w in {_order(k, p) for k, p in zip(asked["key"], asked["page_id"], strict=True)}:
            for b in range(max(bisect.bisect_left(firsts, w) - 1, 0), max(bisect.bisect_right(firsts, w), 1)):
                by_block.setdefault(b, set()).add(w)
        found = []
        with filesystem.open_input_file(f"{root}/{blocks['cluster'][0]}") as f:
            for b, wanted in sorted(by_block.items()):
                f.seek(int(blocks["offset"][b]))
                for line in gzip.decompress(f.read(int(blocks["length"][b]))).decode().splitlines():
                    key, _, page, kind, digest, length, offset, file = line.split(" ")
                    key = key.replace("%20", " ")
                    page = None if page == "-" else int(page)
                    if _order(key, page) in wanted:
                        found.append((key, page, file, int(offset), int(length), kind, digest))
        return pd.DataFrame(found, columns=["key", "page_id", "file", "offset", "length", "record_type", "digest"]).astype(
            {"page_id": "Int64"}
        )

    return named.groupBy("cluster").cogroup(directory.groupBy("cluster")).applyInPandas(second_level, _INDEX)


def read_records(located: DataFrame, folder: str) -> DataFrame:
    """Each capture's record, read by its byte range and parsed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = _filesystem(folder)
        for b in batches:
            out, handle, current = [], None, None
            for r in b.sort_values(["file", "offset"], kind="stable").itertuples(index=False):
                if r.file != current:
                    if handle is not None:
                        handle.close()
                    handle, current = filesystem.open_input_file(f"{root}/{r.file}"), r.file
                handle.seek(int(r.offset))
                rec = parse_record(handle.read(int(r.length)))
                fields = rec["fields"]
                kind = fields["WARC-Type"]
                digest = _hex(fields["WARC-Payload-Digest"].split(":", 1)[1])
                if kind == "response":
                    if hashlib.sha1(rec["payload"]).hexdigest() != digest:
                        raise ValueError(f"payload of {r.file}@{r.offset} does not match its digest")
                    size = len(rec["payload"])
                else:
                    size = None
                out.append((r.page_id, kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), size, digest, r.file, r.offset))
            if handle is not None:
                handle.close()
            yield pd.DataFrame(
                out, columns=["page_id", "record_type", "record_id", "refers_record", "payload_bytes", "payload_digest", "file", "offset"]
            ).astype({"page_id": "Int64", "payload_bytes": "Int64", "offset": "int64"})

    schema = "page_id long, record_type string, record_id string, refers_record string, payload_bytes long, payload_digest string, file string, offset long"
    return located.mapInPandas(read, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write, index and read back ``pages`` (page_id, url, html): a row per page with what its record says.

    Columns: page_id, payload_bytes, payload_digest (hex SHA-1 of the full payload), record_type, refers_to (page of the
    response a revisit refers to), file and offset of the record."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    lines = write_archives(pages.select("page_id", "url", "html"), folder)
    directory = capture_index(lines.select("key", "page_id", "file", "offset", "length", "record_type", "digest"), folder)
    located = lookup(lines.select("key", "page_id").distinct(), directory, folder)
    got = stored(read_records(located, folder))
    heads = got.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("refers_record"), F.col("page_id").alias("head_page"), F.col("payload_bytes").alias("head_bytes"),
        F.col("payload_digest").alias("head_digest"),
    ).dropDuplicates(["refers_record"])
    counts = got.where(F.col("refers_record").isNotNull()).groupBy("refers_record").agg(F.count(F.lit(1)).alias("rows"))
    met = balanced_lookup(got, heads.join(counts, "refers_record"), "refers_record", "rows", ["file", "offset"])
    return met.select(
        "page_id",
        F.coalesce("payload_bytes", "head_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("head_page").alias("refers_to"),
        "file",
        "offset",
        F.when(F.col("head_digest").isNotNull(), F.col("head_digest") == F.col("payload_digest")).alias("digest_agrees"),
    )

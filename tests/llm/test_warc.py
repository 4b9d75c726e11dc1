"""WARC records and the capture index against a plain version."""

from __future__ import annotations

import gzip
import hashlib

import pandas as pd
import pytest

from riskweave.llm import warc
from riskweave.llm.queries import REGISTRY
from tests.conftest import SF

BIG = "<p>" + "copy " * 400 + "</p>"


def plain(rows):
    """Record type, refers_to, size and digest of each (page_id, url, html) row, by the contract."""
    sizes = {k: len((h or "").encode()) for k, (_, _, h) in enumerate(rows)}
    digests = {k: hashlib.sha1((h or "").encode()).hexdigest() for k, (_, _, h) in enumerate(rows)}
    heads: dict[str, int] = {}
    for k, (p, _, _) in enumerate(rows):
        if sizes[k] >= warc.SMALL_PAYLOAD and p is not None:
            heads[digests[k]] = max(heads.get(digests[k], p), p)
    out = []
    for k, (p, _, _) in enumerate(rows):
        head = heads.get(digests[k]) if sizes[k] >= warc.SMALL_PAYLOAD else None
        revisit = head is not None and (p is None or p < head)
        out.append((p, sizes[k], digests[k], "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


def got(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    if extra:  # columns named like the operator's own
        df = df.selectExpr("*", "'x' AS digest", "1 AS rows", "'k' AS key", "'f' AS file", "2 AS head_id")
    out = warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(((r[0], r[1], r[2], r[3], r[4]) for r in out), key=repr)


AWKWARD = [
    (1, "http://www.Example.com:8080/a?b=1#top", "<p>small</p>"),
    (2, None, None),
    (3, "https://example.com/a", BIG),
    (9, "https://example.com/a", BIG),
    (5, "https://other.org/", BIG),
    (None, "https://example.com/n", BIG),
    (7, "https://example.com/s", "<p>small</p>"),
    (7, "https://example.com/s", "<p>small</p>"),
    (8, "https://example.com/long", "é" * 1_500_000),
    (10, "not a url", ""),
    (11, "https://example.com/only-null", None),
    (None, "https://x.net/", "z" * 1000),
    (None, "https://x.net/", "z" * 1000),
]


def test_awkward_rows(spark):
    assert got(spark, AWKWARD, extra=True) == plain(AWKWARD)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_one_key_over_many_blocks(spark, monkeypatch):
    """Equal keys straddle blocks and cluster files; every capture is found by the binary searches."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(k, "https://hot.example.com/", BIG if k % 3 else f"<p>{k}</p>") for k in range(60)] + [(None, "https://hot.example.com/", "a")] * 4
    assert got(spark, rows) == plain(rows)


def test_records_are_warc(spark, tmp_path):
    rows = spark.createDataFrame([(1, "https://a.b/", BIG), (2, "https://a.b/c", BIG)], "page_id long, url string, html string")
    lines = warc.write_archives(rows, str(tmp_path)).collect()
    by_page = {r.page_id: r for r in lines}
    with open(tmp_path / by_page[1].file, "rb") as f:
        f.seek(by_page[1].offset)
        text = gzip.decompress(f.read(by_page[1].length)).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: revisit\r\n") and "WARC-Refers-To: <urn:uuid:" in text
    assert by_page[2].record_type == "response" and by_page[1].key == "b,a)/"


def test_surt():
    assert warc.surt("http://www.Example.COM:80/Path?q=1#frag") == "com,example)/path?q=1"
    assert warc.surt(None) == "-"


def test_query_on_the_table(spark):
    out = REGISTRY["op11_warc_capture_index"](spark, SF).toPandas()
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    want = plain(list(pages[["page_id", "url", "html"]].itertuples(index=False, name=None)))
    assert sorted(map(tuple, out.astype(object).where(out.notna(), None).values.tolist()), key=repr) == want

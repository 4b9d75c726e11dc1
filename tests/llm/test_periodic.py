"""Runs found through the grammar against a direct search over all periods."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd

from riskweave.llm import periodic
from riskweave.llm.queries import REGISTRY
from tests.conftest import SF


def direct(ids):
    """Every maximal stretch of each period, kept if long enough and no smaller period holds."""
    ids = np.asarray(ids)
    n, out = len(ids), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for s, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            e = j + q
            smaller = any(q % d == 0 and bool((ids[s : e - d] == ids[s + d : e]).all()) for d in range(1, q))
            if e - s >= max(6, 4 * q) and not smaller:
                out.append((s, e - s, q))
    return sorted(out)


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    index = periodic.planted(doc_id, words)
    w = [words[i] for i in index]
    _, codes = np.unique(np.array(w, dtype=object), return_inverse=True) if w else (None, np.empty(0, np.int64))
    runs = direct(codes)
    drop = set()
    for s, length, q in runs:
        drop |= set(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for k, x in enumerate(w) if k not in drop)
    return (
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listing.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_grammar_equals_direct_search():
    rnd = random.Random(11)
    for _ in range(300):
        n, alphabet = rnd.randint(0, 150), rnd.choice([1, 2, 3, 4, 40])
        ids = np.array([rnd.randrange(alphabet) for _ in range(n)], np.int64)
        if n > 8 and rnd.random() < 0.5:
            a, p = rnd.randrange(n), rnd.randint(1, 9)
            index = np.arange(n)
            index[a:] = a + (index[a:] - a) % p
            ids = ids[index]
        assert periodic.find_runs(ids) == direct(ids), ids.tolist()


def test_long_text_is_whole():
    """A long planted tail is one run to its end; nothing is cut."""
    rnd = random.Random(5)
    ids = np.array([rnd.randrange(5000) for _ in range(300_000)], np.int64)
    index = np.arange(len(ids))
    index[1234:] = 1234 + (index[1234:] - 1234) % 999
    assert (1234, 300_000 - 1234, 999) in periodic.find_runs(ids[index])


def test_planted_rule():
    """Documents whose crc32 of the id ends in 0 get the periodic tail."""
    d = next(d for d in range(2000) if periodic.zlib.crc32(str(d).encode()) % 10 == 0)
    g = periodic.zlib.crc32(str(d).encode()) // 10
    a, p = g % 50, 1 + (50 - g % 50) // (3 + g % 8)
    assert periodic.planted(d, ["w"] * 50).tolist() == [*range(a), *(a + (i - a) % p for i in range(a, 50))]
    assert (periodic.planted(None, ["w"] * 5) == np.arange(5)).all()


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (5, "a b " * 3), (6, "x " * 100_000), (None, "a a a a a a a"),
           (7, "é ß é ß é ß é ß é ß"), (7, "é ß é ß é ß é ß é ß"), (8, "one two three")]


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string").selectExpr("*", "1 AS n_runs", "'x' AS start")
    got = sorted((r[0] is None, r[0] or 0, tuple(r)[1:]) for r in periodic.periodic_runs(df).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    want = sorted((d is None, d or 0, plain(d, t)) for d, t in AWKWARD)
    assert got == want


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_table(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = {int(d): plain(int(d), t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    got = {r[0]: tuple(r)[1:] for r in REGISTRY["op13_periodic_runs"](spark, SF).collect()}
    assert got == want
    assert sum(v[0] > 0 for v in got.values()) > 0


def expanded(top, made, base):
    out, todo = [], list(reversed(top.tolist()))
    while todo:
        x = todo.pop()
        if x < base:
            out.append(x)
        else:
            todo += [int(made[x - base][1]), int(made[x - base][0])]
    return out


def test_grammar_is_whole():
    """Rules are made until no pair occurs twice, however many it takes."""
    rnd = random.Random(3)
    passages = [[1000 * k + j for j in range(40)] for k in range(30)]
    ids = np.array([w for _ in range(80) for w in rnd.choice(passages)] + [7] * 50 + [rnd.randrange(5) for _ in range(500)], np.int64)
    top, made, lengths = periodic.re_pair(ids)
    assert expanded(top, made, int(ids.max()) + 1) == ids.tolist()
    assert len(made) > 500 and len(lengths) == int(ids.max()) + 1 + len(made)
    seen = {}
    for i, pair in enumerate(zip(top.tolist(), top.tolist()[1:], strict=False)):
        assert i - seen.setdefault(pair, i) <= 1, pair


def test_documents_together_equal_documents_alone():
    rnd = random.Random(4)
    docs = [np.array([rnd.randrange(rnd.choice([1, 2, 30])) for _ in range(rnd.randint(0, 80))], np.int64) for _ in range(200)]
    assert periodic.find_all_runs(docs) == [direct(d) for d in docs]

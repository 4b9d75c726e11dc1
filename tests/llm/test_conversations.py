"""Conversation repair against plain versions: all edit scripts of short conversations, a full-string Viterbi of long ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from riskweave.llm import conversations as conv
from riskweave.llm.queries import REGISTRY
from tests.conftest import SF

PATTERN = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """(conv_id, turn, role, text) rows after damage, ordered, with their first fault."""
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            out.append((c, t, role, text, 0, True))
            continue
        role = "user" if code == 4 else role
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        out += [(c, t, role, text, k, False) for k in range(2 if code == 3 else 1)]
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            f = conv.BLANK
        elif (role, text) in seen:
            f = conv.DUPLICATE
        elif not re.search(r"[.!?][\x20\x09-\x0D]*$", text):
            f = conv.TRUNC
        else:
            f = 0
        seen.add((role, text))
        out.append(f)
    return out


def scripts(rows):
    """Cheapest (cost, audit, hash) over all scripts with up to two inserts per gap."""
    best, n = None, len(rows)
    options = []
    for role, text, fault in rows:
        extra = 3 if fault == conv.TRUNC else 0
        o = [("D", 4, None)]
        if fault not in (conv.BLANK, conv.DUPLICATE):
            o += [("K", extra, (role, text)), ("R", 3 + extra, ("user", text)), ("R", 3 + extra, ("assistant", text))]
        options.append(o)
    inserts = [(), *[(r,) for r in ("user", "assistant")], *itertools.product(("user", "assistant"), repeat=2)]
    for edits in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=n + 1):
            audit, cost, lines = [], 0, []
            for k in range(n + 1):
                for r in gaps[k]:
                    audit, cost, lines = [*audit, "I"], cost + 3, [*lines, (r, "")]
                if k < n:
                    letter, c, line = edits[k]
                    audit, cost = [*audit, letter], cost + c
                    lines = [*lines, line] if line else lines
            if PATTERN.fullmatch("".join(r[:1] for r, _ in lines)):
                key = (cost, "".join(audit), hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
                best = key if best is None or key[:2] < best[:2] else best
    return best


def strings(rows):
    """The same recurrence with whole strings kept in every state (no tree, no pruning)."""
    moves = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def closure(states):
        changed = True
        while changed:
            changed = False
            for s, (c, a, lines) in sorted(states.items()):
                t, role = moves[s]
                cand = (c + 3, a + "I", [*lines, f"{role}:"])
                if t not in states or cand[:2] < states[t][:2]:
                    states[t], changed = cand, True
        return states

    states = closure({0: (0, "", [])})
    for role, text, fault in rows:
        extra, new = (3 if fault == conv.TRUNC else 0), {}

        def offer(s, cand):
            if s not in new or cand[:2] < new[s][:2]:
                new[s] = cand

        for s, (c, a, lines) in states.items():
            offer(s, (c + 4, a + "D", lines))
            if fault in (conv.BLANK, conv.DUPLICATE):
                continue
            k = s if role == "" else {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
            if k is not None:
                offer(k, (c + extra, a + "K", [*lines, f"{role}:{text}"]))
            t, new_role = moves[s]
            offer(t, (c + 3 + extra, a + "R", [*lines, f"{new_role}:{text}"]))
        states = closure(new)
    c, a, lines = min(states[s] for s in (0, 3) if s in states)
    return c, a, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def viterbi(rows):
    r = conv.Repair()
    for row in rows:
        r.row(*row)
    return r.finish()


def test_viterbi_equals_all_scripts():
    rnd = random.Random(7)
    for _ in range(250):
        rows = [(rnd.choice(["user", "assistant", "system", " ", "tool", ""]), rnd.choice(["a.", "b"]), rnd.choice([0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 3))]
        assert viterbi(rows) == scripts(rows), rows


def test_viterbi_equals_strings_on_long_conversations():
    rnd = random.Random(8)
    for n in (1, 10, 200, 2000):
        rows = [(rnd.choice(["user", "assistant", "system", "x"]), "t.", rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        r = conv.Repair()
        for row in rows:
            r.row(*row)
        assert r.finish() == strings(rows)
        assert r.peak < 200  # the unresolved part stays short


def plain(rows):
    """By conversation: the contract's columns from the damaged rows."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = [r for r in damage([r for r in rows if r[0] == c]) if not r[5]]
        mine.sort(key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2], r[3], r[4]))
        f = faults([(r[2], r[3]) for r in mine])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(1 for a, b in itertools.pairwise(initials) if a + b not in conv.LEGAL)
        cost, audit, digest = strings([(r[2], r[3], k) for r, k in zip(mine, f, strict=True)])
        out[c] = (gaps, f.count(1), f.count(2), f.count(3), illegal, cost, audit, digest)
    return out


def got(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.selectExpr("*", "1 AS copy", "'x' AS fault", "true AS dropped", "0 AS code")
    out = conv.repair_conversations(df).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}


AWKWARD = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 3, "assistant", "Hello"),
    (1, None, "user", None), (1, 5, None, "Done."), (2, 0, "user", ""), (2, 1, "user", "  \n"), (None, 4, "assistant", "x."),
    (None, None, None, None), (3, 7, "tool", "é" * 100_000 + "."), (4, 0, "assistant", "Go."), (4, 0, "assistant", "Go."),
]


def test_awkward_rows(spark):
    assert got(spark, AWKWARD, extra=True) == plain(AWKWARD)


def test_dropped_conversation_stays(spark):
    """crc32("0:5") % 20 is 0: the only row drops, the conversation is listed with zeros."""
    assert zlib.crc32(b"0:5") % 20 == 0
    assert got(spark, [(0, 5, "user", "x.")]) == {0: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(spark):
    assert got(spark, []) == {}


def test_query_on_the_table(spark):
    table = pd.read_parquet(f"{SF}/conversations.parquet")
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in table[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    rows = [(None if c is None else int(c), None if t is None else int(t), r, x) for c, t, r, x in rows]
    out = REGISTRY["op12_conversation_repair"](spark, SF).collect()
    assert {r.conv_id: tuple(r)[1:] for r in out} == plain(rows)

"""Conversation structure repair by a survivor-coalescence Viterbi.

A repaired conversation has role initials ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of user and
assistant turns. Each row is kept (K, cost 0), given another role (R, user or assistant, cost 3) or deleted (D, cost 4;
the only edit of a blank or duplicate row); empty user or assistant rows may be inserted anywhere (I, cost 3). A row
whose fault is truncation costs 3 more unless it is deleted. The cheapest edits win; among them the ASCII-least string of
edit initials.

Spark does what needs several rows of a conversation at once: damage (``damaged``), the duplicate flag (a row number
over equal role and text) and the order. Each conversation then streams through one task in turn order, and the Viterbi
keeps one survivor per state of the pattern (start, after s, after u, after a). Survivors are tips of a backpointer tree
whose nodes count their references (children and survivors); a node nobody refers to any more is freed with its
ancestors, and once the root has a single child that no survivor stands on, every survivor shares it: that edit is
final, is written out (audit letter, repaired line into the hash) and becomes the root. Memory is the unresolved part
only, not the conversation. Ties between survivors are settled by comparing their complete unresolved suffixes from
their last common ancestor: two tied paths into one state always differ inside both, so the common prefix already
written cannot change the order.

Defined results: null role or text is one space (before damage); a null conv_id is a conversation of its own; rows are
ordered by turn with nulls first, then role, then text; a row whose role is empty has no initial, so keeping it
changes no state; a conversation whose rows all drop has zeros, an empty audit and
the hash of the empty string; other columns are not carried."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import send_by_value, shuffle_width

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, TRUNC = 1, 2, 3
#: Adjacent role initials that need no repair.
LEGAL = {"su", "ua", "au"}
_SPACE = "[^\\x20\\x09-\\x0D]"
_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, n_rows long"
)

send_by_value(__name__)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage by crc32(``conv_id:turn``) % 20: 0 drops (a marker row stays, so the conversation does), 1 empties
    the text, 2 removes ``.!?``, 3 repeats the row, 4 makes the role user. Columns conv_id, turn, role, text, copy, dropped,
    fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = c.withColumn("code", F.pmod(F.crc32(key), F.lit(20)))
    c = c.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("code") == 0).alias("dropped"),
    )
    first = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = (
        F.when(F.col("dropped"), F.lit(0))
        .when(~F.col("text").rlike(_SPACE), F.lit(BLANK))
        .when(F.row_number().over(first) > 1, F.lit(DUPLICATE))
        .when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*$"), F.lit(TRUNC))
        .otherwise(F.lit(0))
    )
    return c.withColumn("fault", fault)


class _Node:
    """An edit on a path: its letter, the repaired line it writes (or None), and who refers to it."""

    __slots__ = ("letter", "line", "parent", "refs", "tips", "depth")

    def __init__(self, letter: str, line: str | None, parent: _Node | None):
        self.letter, self.line, self.parent, self.refs, self.tips = letter, line, parent, 0, 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.refs += 1


def _release(node: _Node | None) -> None:
    while node is not None and node.refs == 0:
        parent, node.parent = node.parent, None
        if parent is not None:
            parent.refs -= 1
        node = parent


def _apart(a: _Node, b: _Node) -> tuple[list[str], list[str]]:
    """The letters of two paths after their last common node."""
    sa, sb = [], []
    while a.depth > b.depth:
        sa.append(a.letter)
        a = a.parent
    while b.depth > a.depth:
        sb.append(b.letter)
        b = b.parent
    while a is not b:
        sa.append(a.letter)
        sb.append(b.letter)
        a, b = a.parent, b.parent
    return sa[::-1], sb[::-1]


def _better(x: tuple, y: tuple | None) -> bool:
    """Is candidate x = (cost, node, letter) cheaper than y, or as cheap and ASCII-less over the complete strings?"""
    if y is None:
        return True
    if x[0] != y[0]:
        return x[0] < y[0]
    a, b = _apart(x[1], y[1])
    return a + list(x[2]) < b + list(y[2])


class Repair:
    """The Viterbi of one conversation, fed row by row; ``finish`` gives cost, audit and hash."""

    # Inserts: state -> (state, role).
    INSERTS = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def __init__(self) -> None:
        self.root = _Node("", None, None)
        self.survivors: dict[int, tuple[int, _Node]] = {}
        self._hold(0, 0, self.root)
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.lines = 0
        self.peak = 0
        self._inserts()

    def _hold(self, state: int, cost: int, node: _Node) -> None:
        old = self.survivors.get(state)
        node.tips += 1
        node.refs += 1
        self.survivors[state] = (cost, node)
        if old is not None:
            self._drop(old[1])

    def _drop(self, node: _Node) -> None:
        node.tips -= 1
        node.refs -= 1
        _release(node)

    def _choose(self, candidates: dict[int, tuple]) -> None:
        """Make the best candidate of each state its survivor; candidates are (cost, parent node, letter, line)."""
        old = self.survivors
        self.survivors = {}
        for state, (cost, parent, letter, line) in candidates.items():
            node = _Node(letter, line, parent)
            node.tips, node.refs = 1, node.refs + 1
            self.survivors[state] = (cost, node)
        for _, node in old.values():
            self._drop(node)

    #: (weaker, stronger, margin): from the stronger state every continuation of the weaker one can be followed for at
    #: most ``margin`` more (delete the one system row it may keep, insert the row that changes 2 into 3 or back), so a
    #: survivor dearer by more than the margin can't be on the cheapest path and goes. Ties are kept.
    DOMINANCE = ((0, 3, 4), (0, 2, 7), (1, 3, 0), (1, 2, 3), (2, 3, 3), (3, 2, 3))

    def _prune(self) -> None:
        for weak, strong, margin in self.DOMINANCE:
            if weak in self.survivors and strong in self.survivors:
                if self.survivors[strong][0] + margin < self.survivors[weak][0]:
                    self._drop(self.survivors.pop(weak)[1])

    def _inserts(self) -> None:
        """Empty user or assistant rows before the next row, as many as make a state cheaper."""
        changed = True
        while changed:
            changed = False
            for state, (cost, node) in sorted(self.survivors.items()):
                target, role = self.INSERTS[state]
                mine = (cost + INSERT, node, "I")
                held = self.survivors.get(target)
                if held is None or _better(mine, (held[0], held[1], "")):
                    self._hold(target, cost + INSERT, _Node("I", f"{role}:", node))
                    changed = True
                    break

    def row(self, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        extra = TRUNCATED if fault == TRUNC else 0
        candidates: dict[int, tuple] = {}

        def offer(state: int, cost: int, node: _Node, letter: str, line: str | None) -> None:
            held = candidates.get(state)
            if _better((cost, node, letter), None if held is None else held[:3]):
                candidates[state] = (cost, node, letter, line)

        for state, (cost, node) in sorted(self.survivors.items()):
            offer(state, cost + DELETE, node, "D", None)
            if fault in (BLANK, DUPLICATE):
                continue
            kept = state if initial == "" else {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
            if kept is not None:
                offer(kept, cost + KEEP + extra, node, "K", f"{role}:{text}")
            target, new_role = self.INSERTS[state]
            offer(target, cost + REROLE + extra, node, "R", f"{new_role}:{text}")
        self._choose(candidates)
        self._inserts()
        self._prune()
        self._settle()

    def _settle(self) -> None:
        """Write out the edits all survivors share."""
        depth = max(n.depth for _, n in self.survivors.values()) - self.root.depth
        self.peak = max(self.peak, depth)
        while self.root.refs == 1 and self.root.tips == 0:
            tip = next(iter(self.survivors.values()))[1]
            while tip.parent is not self.root:
                tip = tip.parent
            self._emit(tip)
            tip.parent = None
            self.root = tip

    def _emit(self, node: _Node) -> None:
        self.audit.append(node.letter)
        if node.line is not None:
            self.digest.update((b"\n" if self.lines else b"") + node.line.encode())
            self.lines += 1

    def finish(self) -> tuple[int, str, str]:
        best = None
        for state in (0, 3):
            if state in self.survivors:
                cost, node = self.survivors[state]
                if best is None or _better((cost, node, ""), (best[0], best[1], "")):
                    best = (cost, node)
        path = []
        node = best[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._emit(node)
        return best[0], "".join(self.audit), self.digest.hexdigest()


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    current, state = object(), None

    def close() -> None:
        if state is None:
            return
        cost, audit, digest = state["repair"].finish()
        turns = state["turns"]
        gaps = (turns[1] - turns[0] + 1 - turns[2]) if turns[2] else 0
        out.append((state["conv"], gaps, *state["faults"], state["illegal"], cost, audit, digest, state["rows"]))

    for b in batches:
        for conv, turn, role, text, dropped, fault in zip(b["conv_id"], b["turn"], b["role"], b["text"], b["dropped"], b["fault"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if conv != current or state is None:
                close()
                current = conv
                # turns: least, greatest, distinct count, last seen
                state = {"conv": conv, "repair": Repair(), "turns": [0, 0, 0, None], "faults": [0, 0, 0], "illegal": 0, "rows": 0, "last": None}
            if dropped:
                continue
            state["rows"] += 1
            if not pd.isna(turn):
                t, turns = int(turn), state["turns"]
                if turns[2] == 0:
                    turns[0] = t
                if turns[3] != t:
                    turns[2] += 1
                turns[1], turns[3] = t, t
            if fault:
                state["faults"][int(fault) - 1] += 1
            initial = role[:1]
            if state["last"] is not None and state["last"] + initial not in LEGAL:
                state["illegal"] += 1
            state["last"] = initial
            state["repair"].row(role, text, int(fault))
        if len(out) >= 1000:
            yield pd.DataFrame(out, columns=_SCHEMA_COLUMNS).astype({"conv_id": "Int64"})
            out = []
    close()
    yield pd.DataFrame(out, columns=_SCHEMA_COLUMNS).astype({"conv_id": "Int64"})


_SCHEMA_COLUMNS = [c.split(" ")[0] for c in _SCHEMA.split(", ")]


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """A row per conversation of ``conversations`` (conv_id, turn, role, text): the counts of faults and illegal
    neighbours, turn gaps, the cheapest repair's cost and audit, and the SHA-256 of its ``role:text`` lines."""
    rows = damaged(conversations)
    width = shuffle_width(conversations.sparkSession)
    ordered = rows.repartition(width, "conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy"
    )
    return ordered.select("conv_id", "turn", "role", "text", "dropped", "fault").mapInPandas(_repair, _SCHEMA)

"""Periodic runs of words by grammar compression.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``max(MIN_LENGTH, EXPONENT * q)``
long, that no neighbouring word extends with period q.

1. Words get ids and the id sequence is compressed by Re-Pair until no pair of adjacent symbols occurs twice: in each
   round the pairs are counted, and an occurrence becomes its new symbol where its pair is more frequent than those
   that overlap it. Above the remaining top-level symbols a balanced tree of virtual pairs completes the
   derivation, so every two neighbouring words are split by exactly one node's boundary.
2. Every run lies in the expansion of a deepest node and crosses its boundary. For each distinct node, once, the runs
   that cross its boundary inside its expansion are found at its first occurrence: a run of period q crossing boundary m
   has at least 3q positions i with w[i] = w[i + q] in a row, and they include m - 1 or m - q, so two probes per period
   suffice; each probe is extended left and right by longest common extensions (binary search over prefix hashes modulo
   two primes), clamped to the expansion.
3. A nonterminal's runs are translated to every position it has in the derivation. A translated run that a neighbouring
   word of the document extends is not maximal there (it is found again at a higher node); the others are the runs.

Inside a task this is numpy over slices of documents laid end to end: each document has word ids of its own, so no
pair, repetition or run reaches from one into the next. Spark deals documents over tasks.

Defined results: a null text has no words; a null doc_id plants nothing (there is no decimal to hash); repeated rows give
repeated rows; other columns are not carried."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import send_by_value
from .common import mix

MIN_LENGTH = 6
EXPONENT = 4
#: Documents are worked on together in slices of about this many words, one document at least.
SLICE_WORDS = 1 << 17
#: Words an extension is followed one by one before hashes take over.
DIRECT = 8
#: Probes extended at once (memory of a task).
PROBES = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PRIMES = (np.int64(2_147_483_647), np.int64(1_000_000_007))
_BASES = (np.int64(911_382_323), np.int64(972_663_749))
_SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_dropped long"
)

send_by_value(__name__)


def planted(doc_id, words: list[str]) -> np.ndarray:
    """Indices of the original words after the contract's planted repetition."""
    n = len(words)
    index = np.arange(n, dtype=np.int64)
    if doc_id is None or n == 0:
        return index
    h = zlib.crc32(str(int(doc_id)).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        index[a:] = a + (index[a:] - a) % p
    return index


class Hashes:
    """Prefix hashes of a sequence modulo two primes; equal ranges compare equal by cross-multiplied powers.

    Built on first use: most documents have no probe that reaches past the word-by-word steps."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.powers, self.prefix = [], []

    def _build(self) -> None:
        values = self.values
        n = len(values)
        self.powers, self.prefix = [], []
        for p, b in zip(_PRIMES, _BASES, strict=True):
            pw = np.ones(1, np.int64)
            while len(pw) < n + 1:
                pw = np.concatenate([pw, pw * pow(int(b), len(pw), int(p)) % p])
            pw = pw[: n + 1]
            terms = (values % p) * pw[:n] % p
            self.powers.append(pw)
            self.prefix.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(terms) % p]))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not self.prefix:
            self._build()
        out = np.ones(len(i), bool)
        for p, pw, h in zip(_PRIMES, self.powers, self.prefix, strict=True):
            a = (h[i + length] - h[i]) % p * pw[j] % p
            b = (h[j + length] - h[j]) % p * pw[i] % p
            out &= a == b
        return out

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest l <= most with seq[i:i+l] == seq[j:j+l]."""
        lo, hi = np.zeros(len(i), np.int64), most.astype(np.int64)
        while np.any(lo < hi):
            mid = (lo + hi + 1) // 2
            ok = self.equal(i, j, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest l <= most with seq[i-l:i] == seq[j-l:j]."""
        lo, hi = np.zeros(len(i), np.int64), most.astype(np.int64)
        while np.any(lo < hi):
            mid = (lo + hi + 1) // 2
            ok = self.equal(i - mid, j - mid, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo


def _direct(w: np.ndarray, p: np.ndarray, q: np.ndarray, left_most: np.ndarray, right_most: np.ndarray):
    """Equal pairs (i, i + q) to the left of p and from p on, followed one by one up to DIRECT; only probes still going."""
    left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    going_left, going_right = np.flatnonzero(left_most > 0), np.flatnonzero(right_most > 0)
    for step in range(DIRECT):
        going_left = going_left[step < left_most[going_left]]
        i = p[going_left] - 1 - step
        going_left = going_left[w[i] == w[i + q[going_left]]]
        left[going_left] += 1
        going_right = going_right[step < right_most[going_right]]
        j = p[going_right] + step
        going_right = going_right[w[j] == w[j + q[going_right]]]
        right[going_right] += 1
    return left, right


def re_pair(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-level symbols, rules (left, right) and symbols' lengths of a Re-Pair grammar; terminals are ids, rule k is base + k.

    A position is open while its pair may occur twice. Of pairs equally frequent a hash decides, so that a long
    repeated passage is halved by every round."""
    seq = ids.astype(np.int64)
    base = int(seq.max()) + 1 if len(seq) else 0
    made, lengths = [np.empty((0, 2), np.int64)], np.ones(base, np.int64)
    open_ = np.ones(len(seq), bool)
    open_[-1:] = False
    while True:
        # in a stretch of equal symbols, pairs don't overlap: every other one from its start
        same = np.flatnonzero(seq[:-1] == seq[1:])
        first = np.diff(same, prepend=-2) != 1
        odd = same[(same - same[np.maximum.accumulate(np.where(first, np.arange(len(same)), 0))]) % 2 == 1]
        open_[odd] = False
        at = np.flatnonzero(open_)
        keys, pair, counts = np.unique(seq[at] * np.int64(1 << 31) + seq[at + 1], return_inverse=True, return_counts=True)
        often = counts >= 2
        if not often.any():
            break
        order = np.lexsort((mix(keys.view(np.uint64)), -counts))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys), 0, -1)
        twice = often[pair]
        at, pair = at[twice], pair[twice]
        weight = np.zeros(len(seq) + 1, np.int64)
        weight[at] = rank[pair]
        chosen = (weight[at] > weight[at - 1]) & (weight[at] > weight[at + 1])
        used = np.bincount(pair[chosen], minlength=len(keys)) >= 2
        chosen &= used[pair]
        open_[:] = False
        open_[at] = True
        open_[odd] = open_[odd - 1]
        new = np.cumsum(used) - 1
        spot = at[chosen]
        made.append(np.stack(np.divmod(keys[used], np.int64(1 << 31)), axis=1))
        seq[spot] = len(lengths) + new[pair[chosen]]
        lengths = np.concatenate([lengths, lengths[made[-1]].sum(axis=1)])
        open_[spot] = open_[spot - 1] = True
        stays = np.ones(len(seq), bool)
        stays[spot + 1] = False
        seq, open_ = seq[stays], open_[stays]
        open_[-1:] = False
    return seq, np.concatenate(made), lengths


def _nodes(top: np.ndarray, made: np.ndarray, lengths: np.ndarray, cuts: np.ndarray):
    """Each distinct node with a boundary: (first start, length, boundary offset) and its occurrences' starts.

    ``cuts`` are the starts of the documents; no virtual pair reaches over one."""
    base = len(lengths) - len(made)
    starts = np.concatenate([[0], np.cumsum(lengths[top])[:-1]]).astype(np.int64)
    # Occurrences of rules in the derivation, expanded from the top level down.
    occ_pos, occ_sym = [], []
    pos, sym = starts[top >= base], top[top >= base]
    while len(sym):
        occ_pos.append(pos)
        occ_sym.append(sym)
        rule = made[sym - base]
        child_pos = np.concatenate([pos, pos + lengths[rule[:, 0]]])
        child_sym = np.concatenate([rule[:, 0], rule[:, 1]])
        keep = child_sym >= base
        pos, sym = child_pos[keep], child_sym[keep]
    occ_pos = np.concatenate(occ_pos) if occ_pos else np.empty(0, np.int64)
    occ_sym = np.concatenate(occ_sym) if occ_sym else np.empty(0, np.int64)
    # Virtual pairs over the top level, level by level.
    v_start, v_len, v_cut = [], [], []
    level_start, level_len, doc = starts, lengths[top], np.searchsorted(cuts, starts, "right")
    while True:
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        place = np.arange(len(doc)) - np.repeat(first, np.diff(first, append=len(doc)))
        left = np.flatnonzero((place[:-1] % 2 == 0) & (doc[:-1] == doc[1:]))
        if not len(left):
            break
        ll, rl = level_len[left], level_len[left + 1]
        v_start.append(level_start[left])
        v_len.append(ll + rl)
        v_cut.append(ll)
        level_len = level_len.copy()
        level_len[left] = ll + rl
        stays = np.ones(len(doc), bool)
        stays[left + 1] = False
        level_start, level_len, doc = level_start[stays], level_len[stays], doc[stays]
    return occ_pos, occ_sym, v_start, v_len, v_cut


def _crossing(h: Hashes, w: np.ndarray, start: np.ndarray, length: np.ndarray, cut: np.ndarray, node: np.ndarray):
    """(node, start, end, period) of periodic stretches crossing each node's boundary, maximal inside it, long enough."""
    keep = (length >= MIN_LENGTH) & (length >= EXPONENT)
    start, length, cut, node = start[keep], length[keep], cut[keep], node[keep]
    # nodes of many periods together are probed in turns of bounded size
    part = np.cumsum(length // EXPONENT) // PROBES
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(node)]
    turns = [_probed(h, w, start[a:b], length[a:b], cut[a:b], node[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    out = np.concatenate([np.empty((0, 4), np.int64), *turns])
    return np.unique(out, axis=0) if len(out) else out


def _probed(h: Hashes, w: np.ndarray, start: np.ndarray, length: np.ndarray, cut: np.ndarray, node: np.ndarray):
    found = []
    most = length // EXPONENT
    reps = np.repeat(np.arange(len(node)), most)
    q = np.arange(len(reps)) - np.repeat(np.cumsum(most) - most, most) + 1
    m = start[reps] + cut[reps]
    for probe in (m - 1, m - q):
        lo, hi = start[reps], start[reps] + length[reps]
        ok = (probe >= lo) & (probe + q < hi)
        idx = np.flatnonzero(ok)
        idx = idx[w[probe[idx]] == w[probe[idx] + q[idx]]]
        for chunk in range(0, len(idx), PROBES):
            k = idx[chunk : chunk + PROBES]
            p, qq, a, b = probe[k], q[k], lo[k], hi[k]
            left_most, right_most = p - a, b - (p + qq)
            left, right = _direct(w, p, qq, left_most, right_most)
            # A stretch needs max(MIN_LENGTH, EXPONENT q) - q equal pairs; one that can't reach them goes now.
            need = np.maximum(MIN_LENGTH, EXPONENT * qq) - qq
            open_left, open_right = (left == DIRECT) & (left_most > DIRECT), (right == DIRECT) & (right_most > DIRECT)
            keep = (left + right >= need) | open_left | open_right
            k, p, qq, a, b, mm_left, mm_right = k[keep], p[keep], qq[keep], a[keep], b[keep], left_most[keep], right_most[keep]
            left, right, open_left, open_right = left[keep], right[keep], open_left[keep], open_right[keep]
            if open_left.any():
                left[open_left] = h.backward(p[open_left], (p + qq)[open_left], mm_left[open_left])
            if open_right.any():
                right[open_right] = h.forward(p[open_right], (p + qq)[open_right], mm_right[open_right])
            s, e = p - left, p + qq + right
            mm = m[k]
            good = (s <= mm - 1) & (e >= mm + 1) & (e - s >= np.maximum(MIN_LENGTH, EXPONENT * qq))
            found.append(np.stack([node[reps[k]][good], (s - a)[good], (e - a)[good], qq[good]], axis=1))
    return np.concatenate([np.empty((0, 4), np.int64), *found])


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of an id sequence, ordered by start and period."""
    return find_all_runs([ids])[0]


def find_all_runs(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of each id sequence. Sequences are laid end to end, each with ids of its own."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    which_doc = np.flatnonzero(sizes >= MIN_LENGTH)
    if not len(which_doc):
        return out
    kinds = np.array([int(documents[k].max()) + 1 for k in which_doc], np.int64)
    ids = np.concatenate([documents[k].astype(np.int64) + shift for k, shift in zip(which_doc.tolist(), (np.cumsum(kinds) - kinds).tolist(), strict=True)])
    cuts = np.cumsum(sizes[which_doc]) - sizes[which_doc]
    n = len(ids)
    h = Hashes(ids + 1)
    top, made, lengths = re_pair(ids)
    base = len(lengths) - len(made)
    occ_pos, occ_sym, v_start, v_len, v_cut = _nodes(top, made, lengths, cuts)
    runs = []
    # Rules: once each at its first occurrence, then at all occurrences.
    if len(occ_sym):
        symbols, first = np.unique(occ_sym, return_index=True)
        rule = made[symbols - base]
        local = _crossing(h, ids, occ_pos[first], lengths[symbols], lengths[rule[:, 0]], symbols)
        if len(local):
            order = np.argsort(occ_sym, kind="stable")
            sym_sorted, pos_sorted = occ_sym[order], occ_pos[order]
            lo = np.searchsorted(sym_sorted, local[:, 0], "left")
            hi = np.searchsorted(sym_sorted, local[:, 0], "right")
            count = hi - lo
            which = np.repeat(np.arange(len(local)), count)
            at = pos_sorted[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])]
            runs.append(np.stack([at + local[which, 1], at + local[which, 2], local[which, 3]], axis=1))
    if v_start:
        vs, vl, vc = np.concatenate(v_start), np.concatenate(v_len), np.concatenate(v_cut)
        local = _crossing(h, ids, vs, vl, vc, np.arange(len(vs)))
        if len(local):
            runs.append(np.stack([vs[local[:, 0]] + local[:, 1], vs[local[:, 0]] + local[:, 2], local[:, 3]], axis=1))
    if not runs:
        return out
    runs = np.unique(np.concatenate(runs), axis=0)
    s, e, q = runs[:, 0], runs[:, 1], runs[:, 2]
    left_open = (s > 0) & (ids[np.maximum(s - 1, 0)] == ids[np.minimum(s - 1 + q, n - 1)])
    right_open = (e < n) & (ids[np.minimum(e, n - 1)] == ids[np.maximum(e - q, 0)])
    runs = runs[~left_open & ~right_open]
    for s, e, q, k in zip(*runs.T.tolist(), (np.searchsorted(cuts, runs[:, 0], "right") - 1).tolist(), strict=True):
        if any(q % d == 0 and h.equal(np.array([s]), np.array([s + d]), np.array([e - s - d]))[0] for d in range(1, q)):
            continue  # a smaller period holds: the run is found with it
        out[which_doc[k]].append((s - int(cuts[k]), e - s, q))
    return [sorted(found) for found in out]


def prepared(doc_id, text: str | None) -> tuple:
    """A document's words, which original word stands at each place, and the ids there."""
    words = _WORD.findall(text) if text is not None else []
    index = planted(doc_id, words)
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)[index] if words else np.empty(0, np.int64)
    return doc_id, words, index, ids


def described(doc_id, words: list[str], index: np.ndarray, ids: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple:
    """The contract's columns of one document."""
    dropped = np.zeros(len(ids) + 1, np.int64)
    for s, length, q in runs:
        dropped[s + q] += 1
        dropped[s + length] -= 1
    kept = np.cumsum(dropped)[: len(ids)] == 0
    planted_or_cut = len(runs) or (len(index) and index[-1] != len(index) - 1)
    collapsed = " ".join(words[i] for i in index[kept]) if planted_or_cut else " ".join(words)
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (
        None if doc_id is None else int(doc_id),
        len(ids),
        len(runs),
        *(best if best else (None, None, None)),
        (1000 * best[1] // best[2]) if best else None,
        hashlib.sha256(listing.encode()).hexdigest(),
        hashlib.sha256(collapsed.encode()).hexdigest(),
        int((~kept).sum()),
    )


def _slices(b: pd.DataFrame) -> Iterator[list[tuple]]:
    """The batch's documents, prepared, some at a time."""
    held, words = [], 0
    for d, t in zip(b["doc_id"], b["text"], strict=True):
        held.append(prepared(None if pd.isna(d) else d, None if t is None or (isinstance(t, float) and pd.isna(t)) else t))
        words += len(held[-1][3])
        if words >= SLICE_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [described(*d, runs) for held in _slices(b) for d, runs in zip(held, find_all_runs([d[3] for d in held]), strict=True)]
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _SCHEMA.split(", ")]).astype(
            {"doc_id": "Int64", "start": "Int64", "length": "Int64", "period": "Int64", "exponent_milli": "Int64"}
        )


def periodic_runs(documents: DataFrame) -> DataFrame:
    """A row per document of (doc_id, text): its runs, the longest, and hashes of the run list and the collapsed text."""
    return documents.select("doc_id", "text").mapInPandas(_describe, _SCHEMA)

"""Token ids of a byte-level BPE given as a tokenizer file, each distinct word of a slice encoded once.

Such a tokenizer never joins anything over the place before a space that follows a non-space, so a text's
ids are the ids of its pieces cut at these places, one after another. Pieces repeat, so each distinct piece
of a slice of texts is encoded once. ``tiktoken`` encodes them with the vocabulary of the tokenizer file and
gives the ids that ``tokenizers`` gives; very long pieces are encoded by ``tokenizers`` itself."""

from __future__ import annotations

import json
from functools import cache, cached_property

import numpy as np
import pyarrow as pa

from ..session import send_by_value
from .common import buffer, hashes, owner, slices

#: Bytes of a piece from which ``tokenizers`` takes over.
LONG_PIECE = 400
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

send_by_value(__name__)


def is_byte_bpe(spec: dict) -> bool:
    """Whether the file describes a byte-level BPE that cuts at spaces and changes nothing beforehand."""
    cut = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    added = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip")) and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return bool(
        model.get("type") == "BPE" and plain and added and spec.get("normalizer") is None
        and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    )


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """Ids of pieces of text."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not is_byte_bpe(spec):
            raise ValueError(f"{path} is not a byte-level BPE")
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.path = path
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.width[i] = len(word)

    @cached_property
    def slow(self):
        """``tokenizers`` itself, loaded with the first very long piece."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def one(self, piece: bytes) -> list[int]:
        text = piece.decode("utf-8")
        if len(piece) >= LONG_PIECE:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")

    def all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has.

        Pieces that begin with a space and end with something else are encoded as one text: it is cut
        between them again. The widths of the tokens tell where."""
        marked = np.flatnonzero(data == 60)
        plain = (data[start] == 32) & ~space_before(data, end) & (end - start < LONG_PIECE) & (np.searchsorted(marked, end) == np.searchsorted(marked, start))
        odd = np.flatnonzero(~plain)
        own = [self.one(data[start[k] : end[k]].tobytes()) for k in odd]
        size = np.zeros(len(start), np.int64)
        size[odd] = [len(x) for x in own]
        length = (end - start)[plain]
        row = data[spread(start[plain], length)]
        joint = np.array(self.fast.encode_ordinary(row.tobytes().decode("utf-8")), np.uint32)
        size[plain] = np.diff(np.searchsorted(np.cumsum(self.width[joint]), np.cumsum(length)) + 1, prepend=0)
        ids = np.empty(int(size.sum()), np.uint32)
        at = np.cumsum(size) - size
        ids[spread(at[plain], size[plain])] = joint
        ids[spread(at[odd], size[odd])] = [i for x in own for i in x]
        return ids, size


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space may end at a place: white space outside ASCII ends in bytes after C2 or E1 to E3."""
    back = [data[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    return _SPACES[back[0]] | (back[0] >= 128) & ((back[1] == 0xC2) | (back[2] >= 0xE1) & (back[2] <= 0xE3))


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places that no token reaches over: a text's start, and a space after a character that isn't white space."""
    space = np.flatnonzero(data == 32)
    space = space[space > 0]
    cut = np.zeros(len(data), bool)
    cut[space[~space_before(data, space)]] = True
    cut[starts[:-1]] = True
    return np.flatnonzero(cut)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each value, and for each place the number of its value."""
    order = np.argsort(h)
    new = np.diff(h[order], prepend=~h[order[:1]]) != 0
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def encoded(path: str, texts: pa.Array, ids: bool = True):
    """For each slice of the texts: first and last row, tokens per text, and all ids (None unless asked for)."""
    known = pieces(path)
    for first, last in slices(texts):
        data, starts = buffer(texts.slice(first, last - first))
        at = cuts(data, starts)
        end = np.append(at[1:], len(data))
        last_of_text = np.zeros(len(data) + 1, bool)
        last_of_text[starts[1:]] = True
        end = end - last_of_text[end]  # without the line feed behind each text
        at, end = at[end > at], end[end > at]
        if not len(at):
            yield first, last, np.zeros(last - first, np.int64), np.empty(0, np.uint32)
            continue
        where, back = distinct(hashes(data, at, end))
        pool, width = known.all(data, at[where], end[where])
        size = width[back]
        counts = np.bincount(owner(starts[:-1], at), size, last - first).astype(np.int64)
        yield first, last, counts, pool[spread((np.cumsum(width) - width)[back], size)] if ids else None

"""Secrets in texts: broad candidates, and a random forest that takes out the false ones.

Candidates come from three generators, which overlap on purpose; the forest takes out what is no secret:

- runs of at least 12 characters of keys (letters, digits and ``_-+/=``), without a leading ``name=``, that hold a digit, are
  mostly capitals, or mix capitals and small letters with an entropy of at least ``ENTROPY`` bits;
- any value assigned to a password, secret, token, key or credential (``name=``, ``name: "``, ``name is``), whatever its length
  and characters, and values with a digit that follow such a name after a space. A value is what stands in quotes, or all up to
  white space, a quote or the next ``&name=``, without closing punctuation;
- passwords of ``user:password@host``, with or without a scheme before.

Where they overlap, the value of a name stands. Features: length;
how likely the run's character pairs are, after counts over all documents; shares of digits, capitals and hexadecimal
characters, changes between kinds of characters; how much of it consists of words that the same text has elsewhere (dictionary
coverage); the path's depth and whether it names a test or example; and the neighbouring words.

The forest learns from labelled findings. Where none are given, findings that state what they are serve as such: a known
key format or an assignment to a password, secret, token or key is a secret; plain numbers, runs of dictionary words,
and digests, revisions or identifiers named as such are not. It is fitted on at most ``sample`` labelled findings of each
class, the first by hash, weighted by how many of its class each stands for, so a rare class is never missed and shares
are those of all findings; everything else covers all findings. With one class only, or none, there is nothing to learn:
what findings state of themselves decides, and those that state nothing are not secrets.

Defined results: a null or empty text has no candidates; repeated rows have theirs each; other columns are not carried by
``find_secrets`` and pass through ``redact`` (``n_chars`` follows the new text)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_by_value
from .common import buffer, scratch, slices, small, stored

SAMPLE = 20_000
TREES = 40
DEPTH = 6
THRESHOLD = 0.5
MASK = "<SECRET>"
CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{12,}")
WORD = re.compile(r"[^\W\d_]{3,}")
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Bits a character; texts of 12 characters reach at most 3.6.
ENTROPY = 3.0
FORMAT = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
NAMES = re.compile(r"(?i)(passw(or)?d|pwd|secret|token|api_?key|access_?key|auth|credential)\W*$")
_NAME = r"(?:passw(?:or)?d|pwd|secret|token|api_?key|access_?key|auth|credential)"
#: One of these stands in each name.
LITERALS = ("passw", "pwd", "secret", "token", "api", "access", "auth", "credential")
#: A value is either in quotes or bare.
_BARE = r"(?:(?!&[\w.-]+=)[^\s\"'`])+"
_VALUE = rf"""(?:"(?P<double>[^"\n]+)"|'(?P<single>[^'\n]+)'|(?P<bare>{_BARE}))"""
VALUE = re.compile(rf"""(?i){_NAME}["'`)\]]*(?:\s*(?:=>|:=|==?|:)\s*|\s+(?:is|was)\s+){_VALUE}""")
SPACED = re.compile(rf"""(?i){_NAME}\s+["']?(?P<bare>(?=[^\s"'`]*\d)(?=[^\s"'`]*[a-z]){_BARE})""")
USER = re.compile(r"(?P<scheme>://)?(?<![^\s/\"'(<=])(?P<user>[\w.%+-]*):(?!//|\d{1,5}/)(?P<bare>[^\s@\"'<>]{1,256})@(?=[\w\[])")
MAIL = re.compile(r"(?i)^(mailto|e-?mail|contact|to|from|b?cc|reply-to|write|mail|sender|author|by)$")
USERINFO = re.compile(r"://[^\s:/@]*:$")
PLACEHOLDER = re.compile(r"<.*|\*+|[xX]{3,}|\$\{.*|\{\{.*|%\(.*|\$[A-Z_]+|(?i:none|null|nil|true|false|str|string|bytes|todo|redacted|changeme)|optional\W.*|\w+[.][\w.]*[(\[].*|\w+\([\w)]*")
PLAIN = re.compile(r"[A-Z]?[^\W\d_A-Z]+")
CLOSING = ".,;:)]}>"
BENIGN = re.compile(r"(?i)(sha\d*|md5|digest|checksum|commit|revision|uuid|guid|etag|isbn|order|phone|version)\W*$")
ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
TESTS = re.compile(r"(?i)(^|[/_.-])(tests?|examples?|mock|fixtures?|samples?)([/_.-]|$)")
FEATURES = ("size", "pairs", "digits", "capitals", "hexadecimal", "changes", "covered", "depth", "in_test", "named", "benign", "assigned", "quoted")
FIELDS = ", ".join(f"{f} double" for f in FEATURES)

send_by_value(__name__)


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs of ASCII bytes in a batch."""
    for b in batches:
        total = np.zeros(1 << 14, np.int64)
        for first, last in slices(b.column(0)):
            data = buffer(b.column(0).slice(first, last - first))[0].astype(np.int32)
            pair = (data[:-1] << 7) | data[1:]
            total += np.bincount(pair[(data[:-1] < 128) & (data[1:] < 128)], minlength=1 << 14)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])


def pair_logs(docs: DataFrame) -> list[float]:
    """For each pair of ASCII characters the log of its share among pairs with the same first one: 16,384 numbers."""
    counts = docs.select(F.col("text").cast("string")).mapInArrow(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = np.ones(1 << 14)
    for r in counts.collect():  # one row per pair of ASCII characters at most
        table[r.pair] += r.n
    table = table.reshape(128, 128)
    return np.log(table / table.sum(axis=1, keepdims=True)).ravel().tolist()


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(text: str, start: int, end: int, words: set[str], path: str, logs: list[float]) -> list[float]:
    run = text[start:end]
    n = len(run)
    before, after = text[max(start - 40, 0) : start], text[end : end + 1]
    named = bool(NAMES.search(re.sub(r"\s+(is|was)\s+$", "", before).rstrip("=:>\"' "))) or bool(USERINFO.search(before) and after == "@")
    # names in capitals and small letters are words too, but a password made of words stays one
    parts = WORD.findall(run) if named else [w for p in WORD.findall(run) for w in ([p] if p.lower() in words else HUMP.findall(p))]
    # pairs outside ASCII count as one of 128 equal ones
    pairs = sum(logs[(ord(a) << 7) | ord(b)] if a < "\x80" and b < "\x80" else -np.log(128) for a, b in zip(run, run[1:], strict=False)) / max(n - 1, 1)
    return [
        float(n),
        pairs,
        sum(map(str.isdigit, run)) / n,
        sum(map(str.isupper, run)) / n,
        sum(c in "0123456789abcdefABCDEF" for c in run) / n,
        sum(kind(a) != kind(b) for a, b in zip(run, run[1:], strict=False)) / max(n - 1, 1),
        sum(len(w) for w in parts if w.lower() in words) / n,
        float(path.count("/")),
        float(bool(TESTS.search(path))),
        float(named),
        float(bool(BENIGN.search(before.rstrip("=:\"' ")))),
        float(bool(ASSIGNED.search(before) or re.search(r"\s(is|was)\s+$", before))),
        float(before[-1:] in ("'", '"') and after == before[-1:]),
    ]


def stated(run: str, f: list[float], before: str = "=") -> int | None:
    """1: says to be a secret; 0: says not to be one. ``before``: the character before."""
    x = dict(zip(FEATURES, f, strict=True))
    if x["named"] and PLACEHOLDER.fullmatch(run):
        return 0
    # a plain word after "secret: " may be prose: the forest decides
    if x["named"] and PLAIN.fullmatch(run) and not x["quoted"] and before.isspace():
        return 0 if x["covered"] > 0.6 else None
    if FORMAT.fullmatch(run) or (x["named"] and x["assigned"] and x["covered"] < 0.5):
        return 1
    if x["benign"] or x["digits"] > 0.9 or x["covered"] > 0.6 or (x["in_test"] and not x["named"]):
        return 0
    return None


def mixed(run: str) -> bool:
    """Capitals after the first letter and small letters in an order of high entropy."""
    if run[1:].islower() or run.isupper():
        return False
    share = np.unique(list(run), return_counts=True)[1] / len(run)
    return float(-(share * np.log2(share)).sum()) >= ENTROPY


def values_of(text: str) -> list[tuple[int, int]]:
    """Start and end of the values of names, in order and apart from each other."""
    found = []
    low = text.lower()
    patterns = (VALUE, SPACED) if any(x in low for x in LITERALS) else ()
    matches = [m for pattern in patterns for m in pattern.finditer(text)]
    at = text.find("@")
    while at >= 0:
        # the regular expression runs only over tokens that hold a colon before the @
        token = re.search(r"\S*\Z", text[max(at - 400, 0) : at]).group()
        if ":" in token and (m := USER.search(text, at - len(token), at + 2)):
            if m["scheme"] or not (MAIL.match(m["user"]) or not m["user"] or m["bare"].isalpha()):
                matches.append(m)
        at = text.find("@", at + 1)
    for m in matches:
        start, end = m.span(m.lastgroup if m.re is VALUE else "bare")
        if m.re is not VALUE or m.lastgroup == "bare":
            while end > start and text[end - 1] in CLOSING:
                end -= 1
        if end > start:
            found.append((start, end))
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(found)):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def spans_of(text: str) -> list[tuple[int, int]]:
    """Start and end of the candidates."""
    values = values_of(text)
    out, k = list(values), 0
    for m in CANDIDATE.finditer(text):
        while k < len(values) and values[k][1] <= m.start():
            k += 1
        start, run = m.start(), m.group()
        if k < len(values) and values[k][0] < m.end():
            # what stands before the value's name may be a key of its own
            run = NAMES.sub("", text[start : max(values[k][0], start)])
        name, _, value = run.partition("=")
        if len(value.rstrip("=")) >= 8:
            start, run = start + len(name) + 1, value
        elif len(run) < 12:
            continue
        if any(map(str.isdigit, run)) or 5 * sum(map(str.isupper, run)) > 4 * len(run) or mixed(run):
            out.append((start, start + len(run)))
    return sorted(out)


def candidates_of(logs: list[float]):
    """(doc_id, path, text) to candidates with features."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, rows = [], []
            for k, (path, text) in enumerate(zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True)):
                found = spans_of(text or "")
                if not found:
                    continue
                outside, at = [], 0
                for start, end in found:
                    outside.append(text[at:start])
                    at = end
                words = {w.lower() for w in WORD.findall(" ".join([*outside, text[at:]]))}
                for start, end in found:
                    f = features(text, start, end, words, path or "", logs)
                    run = text[start:end]
                    place.append(k)
                    rows.append((start, end, run, stated(run, f, text[start - 1 : start]), f))
            columns = list(zip(*[r[4] for r in rows], strict=True)) if rows else [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(place, pa.int64())),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.string()),
                    pa.array([r[3] for r in rows], pa.int32()),
                    *[pa.array(c, pa.float64()) for c in columns],
                ],
                ["doc_id", "start", "end", "secret", "label", *FEATURES],
            )

    return find


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text) to candidates (doc_id, start, end, secret, label, features); places in characters."""
    rows = docs.select("doc_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, end long, secret string, label int, {FIELDS}"
    return rows.mapInArrow(candidates_of(pair_logs(docs)), schema)


def fit(labelled: DataFrame, sample: int = SAMPLE):
    """A forest over labelled findings, at most ``sample`` of each class; None if they are of one class."""
    sizes = {r.label: r.n for r in labelled.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    key = F.xxhash64("secret", "start", "doc_id")

    def chosen(label: int) -> DataFrame:
        weight = F.lit(sizes[label] / min(sizes[label], sample)).alias("weight")
        own = labelled.where(F.col("label") == label).orderBy(key, "secret", "start").limit(sample)
        return own.select(F.col("label").cast("double").alias("label"), weight, *FEATURES)

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(stored(chosen(0).unionByName(chosen(1))))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=7, probabilityCol="both")
    return forest.fit(rows)


def scored(found: DataFrame, model) -> DataFrame:
    """Candidates with ``probability`` of being a secret; without a model, what they state."""
    if model is None:
        return found.withColumn("probability", F.coalesce(F.col("label").cast("double"), F.lit(0.0)))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(found)
    out = model.setPredictionCol("").setRawPredictionCol("").transform(rows)
    return out.withColumn("probability", vector_to_array("both")[1]).drop("vector", "both")


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """All candidates of (doc_id, path, text) with probability and verdict ``is_secret``.

    ``labelled``: findings with features and ``label``, as ``candidates`` gives them."""
    found = stored(candidates(docs))
    model = fit(found if labelled is None else labelled, sample)
    return scored(found, model).withColumn("is_secret", F.col("probability") >= threshold)


def redact(docs: DataFrame, path, mask: str = MASK) -> DataFrame:
    """The documents with each secret replaced; ``path`` is a column expression."""
    keyed = docs.withColumn("_key", F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    with scratch(docs.sparkSession):
        found = find_secrets(keyed.select(F.struct("_key", path.alias("path")).alias("doc_id"), path.alias("path"), "text"))
        spans = found.where("is_secret").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
        spans = stored(spans.select(F.col("doc_id._key").alias("_k"), F.col("doc_id.path").alias("_p"), "_spans"), keep=True)
    # texts are far longer than the list of their secrets
    met = keyed.withColumn("_path", path).join(small(spans), (F.col("_key") == F.col("_k")) & F.col("_path").eqNullSafe(F.col("_p")), "left")
    piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    kept = F.transform("_spans", lambda s, i: piece(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("_spans"), i - 1)["end"]), s.start))
    tail = piece(F.element_at("_spans", -1)["end"], F.length("text").cast("long"))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.concat(kept, F.array(tail)), mask)))
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        changed = F.length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(changed).alias("n_chars")
    return met.select(*[new.get(c, F.col(c)) for c in docs.columns])

"""Personal data in texts: fixed formats, and further spans chosen by boosted trees.

Formats (email, ip, card, phone) are matched as given and checked (Luhn, parts, numbers of digits). Generators of high
recall then propose further, possibly overlapping spans: spelled-out addresses, numbers without a country code, card-like
numbers whatever their check digit, long IP addresses. Gradient-boosted trees judge the proposals by format and context.
They learn from all proposals that agree with a checked format (personal) and from all that neither agree with one
nor stand near a word of their kind (not personal), equal ones counted together and weighted by their number; an eighth
of these, by hash, is set aside, and the threshold is the lowest score from which the precision there is ``precision``.
Spans of formats always stay.

Everything is built-in functions and Spark's own trees. Expressions are written without backtracking over groups, so
long runs of digits or letters cost linear time. Places are code points. Defined results: a null or empty text has no
spans; repeated rows have theirs each; other columns are not carried; if proposals are all of one class none is added."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: The formats; an address may start where the one before it ended.
FORMATS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?: ?@ ?| ?[(\[]at[)\]] ?){_LABEL}++(?:(?: ?[(\[]dot[)\]] ?|\.){_LABEL}++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}+ ?)?+\(?+[0-9]{2,4}+\)?+[\x20.-]{1,2}+[0-9]{3,4}+[\x20.-][0-9]{3,5}+(?![0-9])",
}
NEEDED = {"email": r"@|[(\[]at[)\]]", "ip": r"[.:]", "card": r"[0-9]", "phone": r"[0-9]"}
NEARBY = {
    "email": r"(?i)(mail|contact|write|reach|address)",
    "ip": r"(?i)(\bip\b|host|server|address|login)",
    "card": r"(?i)(card|visa|account|payment|billing)",
    "phone": r"(?i)(phone|call|tel\b|mobile|fax|contact|reach)",
}
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CONTEXT = 32
ROUNDS = 20
DEPTH = 4
PRECISION = 0.95
FEATURES = (*[f"is_{k}" for k in KINDS], "size", "digits", "letters", "breaks", "luhn", "parts", "near", "after_digit", "before_letter", "lines", "plus")
BLOCK = 256


def let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(a: Column) -> Column:
    """The sum before each element, in blocks so that long arrays are not copied for each element."""
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<long>")
    inner = lambda s: F.aggregate(
        s, F.struct(empty.alias("v"), zero.alias("t")), lambda c, x: F.struct(F.concat(c.v, F.array(c.t)).alias("v"), (c.t + x).alias("t"))
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda k: inner(F.slice(a, k * BLOCK + 1, BLOCK)))
    joined = F.aggregate(
        blocks,
        F.struct(empty.alias("v"), zero.alias("t")),
        lambda c, b: F.struct(F.concat(c.v, F.transform(b.v, lambda x: x + c.t)).alias("v"), (c.t + b.t).alias("t")),
    )
    return F.when(F.size(a) > 0, joined.v).otherwise(empty)


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern as (start, end, match): what stands between matches gives their places."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(b: Column) -> Column:
        step = F.transform(b.m, lambda m, i: (F.length(F.get(b.p, i)) + F.length(m)).cast("long"))

        def build(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(b.p, i))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"))

            return F.transform(b.m, one)

        return let(running(step), build)

    return let(both, placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


NONE = "array<struct<start: bigint, kind: int, end: bigint>>"
PROPOSAL = "array<struct<kind: int, start: bigint, end: bigint, match: string, before: string, after: string>>"


def format_spans(text: Column, k: int) -> Column:
    """Checked spans of one kind, as (start, kind number, end)."""
    own = F.filter(spans(text, FORMATS[KINDS[k]]), lambda s: valid(KINDS[k], s.match))
    own = F.transform(own, lambda s: F.struct(s.start, F.lit(k).alias("kind"), s.end))
    return F.when(text.rlike(NEEDED[KINDS[k]]), own).otherwise(F.array()).cast(NONE)


def formats(text: Column) -> Column:
    return F.sort_array(F.concat(*[format_spans(text, k) for k in range(len(KINDS))]))


def proposed(text: Column, k: int) -> Column:
    """What one generator finds, with the characters around it."""

    def around(s: Column) -> Column:
        low = F.greatest(s.start - CONTEXT, F.lit(0))
        return F.struct(
            F.lit(k).alias("kind"), s.start, s.end, s.match,
            F.substring(text, (low + 1).cast("int"), (s.start - low).cast("int")).alias("before"),
            F.substring(text, (s.end + 1).cast("int"), F.lit(CONTEXT)).alias("after"),
        )

    found = F.transform(spans(text, GENERATORS[KINDS[k]]), around)
    return F.when(text.rlike(NEEDED[KINDS[k]]), found).otherwise(F.array()).cast(PROPOSAL)


def proposals(text: Column) -> Column:
    return F.concat(*[proposed(text, k) for k in range(len(KINDS))])


def count_of(spans_: str, k: int) -> Column:
    """Spans of one kind."""
    return F.size(F.filter(spans_, lambda s: s.kind == k)).cast("long")


def with_features(rows: DataFrame) -> DataFrame:
    """Proposals (row, base, p) with features, and ``label`` where it is plain."""
    m = F.col("p.match")
    count = lambda pattern: F.length(F.regexp_replace(m, pattern, "")).cast("double")
    digits = F.regexp_replace(m, "[^0-9]", "")
    near = F.lit(False)
    for k, kind in enumerate(KINDS):
        near = near | ((F.col("p.kind") == k) & (F.col("p.before").rlike(NEARBY[kind]) | F.col("p.after").rlike(NEARBY[kind])))
    values = {f"is_{kind}": F.col("p.kind") == k for k, kind in enumerate(KINDS)} | {
        "size": F.length(m),
        "digits": count("[^0-9]"),
        "letters": count("[^A-Za-z]"),
        "breaks": count("[^ ().-]"),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False),
        "parts": F.size(F.split(m, r"[^0-9A-Za-z]+")),
        "near": near,
        "after_digit": F.col("p.before").rlike("[0-9]$"),
        "before_letter": F.col("p.after").rlike("^[A-Za-z]"),
        "lines": F.col("p.before").rlike(r"\n$"),
        "plus": F.col("p.match").startswith("+"),
    }
    # the same place and kind as a checked span, to the character
    agrees = F.exists("base", lambda b: (b.kind == F.col("p.kind")) & (b.start <= F.col("p.start")) & (b.end >= F.col("p.end")))
    label = F.when(agrees, 1.0).when(~near, 0.0)
    return rows.select("row", "p", agrees.alias("known"), label.alias("label"), *[v.cast("double").alias(n) for n, v in values.items()])


def weighted(found: DataFrame) -> DataFrame:
    """All labelled proposals, equal ones in one row: ``train`` and ``aside`` say how many of them are on either side."""
    aside = (F.pmod(F.xxhash64("row", "p.start", "p.kind"), F.lit(8)) == 0).cast("long")
    rows = found.where("label is not null").groupBy("label", *FEATURES)
    return rows.agg(F.sum(1 - aside).cast("double").alias("train"), F.sum(aside).alias("aside"))


def fit(found: DataFrame, rounds: int, precision: float):
    """The trees and the threshold, or None if the labels are of one class."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(stored(weighted(found)))
    train, aside = rows.where("train > 0"), rows.where("aside > 0")
    if train.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="train", maxIter=rounds, maxDepth=DEPTH, seed=11).fit(train)
    # scores have six digits, which bounds this window over them
    score = trees.transform(aside).select("label", "aside", F.round(vector_to_array("probability")[1], 6).alias("score"))
    by_score = score.groupBy("score").agg(F.sum(F.col("label") * F.col("aside")).alias("hits"), F.sum("aside").alias("n"))
    down = Window.orderBy(F.desc("score"))
    best = by_score.select("score", (F.sum("hits").over(down) / F.sum("n").over(down)).alias("precision"))
    threshold = best.where(F.col("precision") >= precision).agg(F.min("score")).first()[0]
    return trees, max(0.5, threshold) if threshold is not None else 1.0


def find_pii(docs: DataFrame, rounds: int = ROUNDS, precision: float = PRECISION) -> DataFrame:
    """(doc_id, base, spans) per document of (doc_id, text): arrays of (start, kind, end), kinds as numbered in KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = docs.select("doc_id", text.alias("text"))
    rows = stored(some.select(F.monotonically_increasing_id().alias("row"), "doc_id", formats(F.col("text")).alias("base"), proposals(F.col("text")).alias("proposals")))
    found = stored(with_features(rows.select("row", "base", F.explode("proposals").alias("p"))))
    model = fit(found, rounds, precision)
    if model is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    trees, threshold = model
    scored = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(found.where("not known"))
    chosen = trees.transform(scored).where(F.round(vector_to_array("probability")[1], 6) >= threshold)
    added = chosen.groupBy("row").agg(F.collect_set(F.struct("p.start", "p.kind", "p.end")).alias("added"))
    both = F.sort_array(F.array_distinct(F.concat("base", F.coalesce("added", F.array().cast(NONE)))))
    return rows.join(added, "row", "left").select("doc_id", "base", both.alias("spans"))


def listed(a: Column) -> Column:
    """Spans as kind:start:end, by start and kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")

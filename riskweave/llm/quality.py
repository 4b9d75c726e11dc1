"""Quality rules whose limits follow each language and source.

Every document gets whole-number signals. Their distributions are kept per language and source as sketches: counts
by bucket, where a bucket is a value's six leading bits, so that a quantile is off by at most a 32nd. Sketches of
parts merge by adding counts, whatever the order, and the sketches of a language or of everything are sums of those
of its sources. A limit is the upper quartile plus a multiple of the upper half-spread plus a slack that keeps
ordinary texts of very even sources; for shares of repeats, which are 0 for most texts, the slack is a small floor plus twice the
way from the upper quartile to the 95th percentile of the group, 300 thousandths at most, so it is well below the fixed 30 % in clean sources; groups of few documents take the limits of their language, or of everything.
Documents meet the limits of their group in a join, and those beyond one are turned down.

Only built-in functions are used. Defined results: a null or empty text has no words and fails; a null language or
source is a group of its own; repeated rows are judged each; existing columns pass through, and one with the name of
the signals is replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW_WORDS = 8
#: Documents from which a group has limits of its own.
GROUP_DOCS = 50
#: Groups up to which their limits are broadcast; beyond that documents are joined to them in salted parts.
BROADCAST_GROUPS = 100_000
SALTS = 64
SPREADS = 6
#: Signal, slack above the limit, and whether low values are turned down too.
SIGNALS = (("symbols", 100, False), ("dup_lines", 150, False), ("repeats", 150, False), ("word_length", 300, True))
#: Signals whose slack grows with the group's tail, by this multiple of the way to the 95th percentile.
TAILED = ("dup_lines", "repeats")
TAILS = 2
#: Slack up to which it grows.
MOST_SLACK = 300


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight found at least twice."""
    size = WINDOW_WORDS

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            twin = F.filter(s, lambda e, j: (e.x == F.get(s, j - 1).x) | (e.x == F.get(s, j + 1).x))
            return F.sort_array(F.transform(twin, lambda e: e.i))

        def union(p: Column) -> Column:
            parts = F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size))))
            return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

        twice = F.coalesce(F.size(F.array_distinct(h)) < F.size(h), F.lit(False))
        return F.when(twice, let(let(pairs, repeated), union)).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))

    return F.when(F.size(words) > size, let(let(words, windows), covered)).otherwise(F.lit(0)).cast("long")


def with_signals(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a column of signals; ratios are in thousandths, word length in hundredths."""
    rest = [c for c in docs.columns if c != out]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    filled = lambda a: F.filter(a, lambda w: w != "")
    parts = docs.select(*rest, F.struct(filled(F.split(body, SPACE)).alias("w"), F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"), body.alias("t")).alias(out))
    words, lines = F.col(f"{out}.w"), F.col(f"{out}.l")
    counted = parts.select(
        *rest,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(F.col(f"{out}.t"), SYMBOLS, "")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
        ).alias(out),
    )
    q = lambda name: F.col(f"{out}.{name}")
    share = lambda a, b, unit: F.when(b > 0, F.floor(a * unit / b)).otherwise(0)
    return counted.select(
        *rest,
        F.struct(
            f"{out}.*",
            share(q("n_symbols"), q("n_words"), 1000).alias("symbols"),
            share(q("n_dup_lines"), q("n_lines"), 1000).alias("dup_lines"),
            share(q("n_repeat_words"), q("n_words"), 1000).alias("repeats"),
            share(q("word_chars"), q("n_words"), 100).alias("word_length"),
            ((q("n_words") < 20) | (100 * q("n_repeat_words") > 30 * q("n_words"))).alias("base_failed"),
        ).alias(out),
    )


def bucket(x: Column) -> Column:
    """A value with all but its six leading bits cleared."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    scale = F.pow(F.lit(2.0), shift).cast("long")
    return F.floor(x / scale) * scale


def sketches(signals: DataFrame, out: str = "quality") -> DataFrame:
    """(lang, source, level, signal, bucket, n): level 0 is a language's source, 1 a language, 2 everything."""
    own = signals.select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), bucket(F.col(f"{out}.{s}")).alias("bucket")) for s, _, _ in SIGNALS])).alias("v")
    )
    base = own.groupBy("lang", "source", F.lit(0).alias("level"), "v.signal", "v.bucket").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    by_lang = base.groupBy("lang", none.alias("source"), F.lit(1).alias("level"), "signal", "bucket").agg(F.sum("n").alias("n"))
    return base.unionByName(by_lang).unionByName(
        by_lang.groupBy(none.alias("lang"), none.alias("source"), F.lit(2).alias("level"), "signal", "bucket").agg(F.sum("n").alias("n"))
    )


def limits(sketch: DataFrame, group_docs: int = GROUP_DOCS, spreads: int = SPREADS) -> DataFrame:
    """(lang, source) with ``low`` and ``high`` of each signal."""
    key = ["lang", "source", "level", "signal"]
    whole, so_far = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("bucket")
    ranked = sketch.withColumn("total", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(so_far))
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    q = ranked.groupBy(*key).agg(F.max("total").alias("total"), at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75"), at(95).alias("q95"))
    slack = F.create_map(*[F.lit(x) for s, v, _ in SIGNALS for x in (s, v)])
    two_sided = F.col("signal").isin([s for s, _, low in SIGNALS if low])
    tail = TAILS * (F.col("q95") - F.col("q75"))
    own_slack = slack[F.col("signal")]
    own_slack = F.when(F.col("signal").isin(*TAILED), F.least(own_slack + tail, F.lit(MOST_SLACK))).otherwise(own_slack)
    q = q.select(
        *key,
        "total",
        F.struct(
            "signal",
            F.when(two_sided, F.col("q25") - spreads * (F.col("q50") - F.col("q25")) - slack[F.col("signal")]).alias("low"),
            (F.col("q75") + spreads * (F.col("q75") - F.col("q50")) + own_slack).alias("high"),
        ).alias("limit"),
    )
    sets = q.groupBy("lang", "source", "level").agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("limit.signal", "limit"))).alias("m"))
    groups = sets.where("level = 0").select("lang", "source", "total", F.col("m").alias("own"))
    langs = sets.where("level = 1").select(F.col("lang").alias("l"), F.col("total").alias("lang_total"), F.col("m").alias("of_lang"))
    every = sets.where("level = 2").select(F.col("m").alias("of_all"), F.lit(1).alias("one"))
    met = groups.join(langs, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("one", F.lit(1)).join(F.broadcast(every), "one", "left")
    chosen = F.when(F.col("total") >= group_docs, F.col("own")).when(F.col("lang_total") >= group_docs, F.col("of_lang")).otherwise(F.col("of_all"))
    return met.select("lang", "source", chosen.alias("limits"))


def judged(signals: DataFrame, groups: DataFrame, out: str = "quality", verdict: str = "kept") -> DataFrame:
    """The signals with the verdict of the document's group."""
    rest = [c for c in signals.columns if c != verdict]
    few = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("limits").alias("_limits"))
    own = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    if groups.count() <= BROADCAST_GROUPS:
        met = signals.select(*rest).join(F.broadcast(few), own, "left")
    else:
        few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        part = F.pmod(F.xxhash64(F.col(out)), F.lit(SALTS)).cast("int")
        met = signals.select(*rest, part.alias("_part")).join(few, own & (F.col("_part") == F.col("_salt")), "left")
    beyond = F.lit(False)
    for s, _, _ in SIGNALS:
        limit = F.col("_limits")[s]
        beyond = beyond | F.coalesce((F.col(f"{out}.{s}") > limit.high) | (F.col(f"{out}.{s}") < limit.low), F.lit(False))
    return met.select(*rest, (~(F.col(f"{out}.base_failed") | beyond)).alias(verdict))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents (with ``lang`` and ``source``) that pass; signals are worked out for the limits and again for the verdict."""
    columns = docs.columns
    signals = with_signals(docs, text, "_quality")
    groups = stored(limits(sketches(signals, "_quality")))
    return judged(signals, groups, "_quality", "_kept").where("_kept").select(*columns)

"""Fuzzy linking of accounts by name: first come, first linked.

Profiles are visited in order of appearance. One that nobody has claimed yet becomes an
anchor and claims its best later matches (at most ``fuzzy_limit``, by score, then order);
a later claim on the same account replaces an earlier one. Which matches a profile would
claim does not depend on the visit, so all claims are computed up front; only who becomes
an anchor is settled in rounds. Without a limit (``None``) an anchor claims every later
match, so only the first copy of a text can be one, and texts are settled instead of profiles.

Profiles with the same comparison form are copies. Copies claim the copies right after
them, so a name shared by a large part of all accounts costs one sort. Every grouping of
copies is cut by range partitions (``part``), never held by a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.similarity import comparison_form
from ..session import materialize, send_by_value, together
from .similarity_join import similar_pairs
from .skew import heaviest, skew_join

send_by_value(__name__)

CLEAR, MARKED, OPEN = 0, 1, 2
UNKNOWN = -1


def distinct_profiles(df: DataFrame) -> DataFrame:
    """Accounts with their names, and when each combination was first seen."""
    return (
        df.where(F.col("sender_id").isNotNull() & F.col("sender_name").isNotNull())
        .groupBy("sender_id", "sender_name")
        .agg(F.min("timestamp").alias("first_seen"))
    )


def numbered_profiles(profiles: DataFrame, scorer: str) -> DataFrame:
    """Profiles with a number that follows the order of appearance; ties go by account and name."""
    order = ["first_seen", "sender_id", "sender_name"]
    return (
        profiles.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            F.monotonically_increasing_id().alias("i"),
            "sender_id",
            comparison_form(F.col("sender_name"), scorer).alias("text"),
        )
    )


def in_range_parts(df: DataFrame, part: str) -> DataFrame:
    """Sort-split by (text, i): large texts fall into several parts, each part in order."""
    return materialize(df.repartitionByRange("text", "i").withColumn(part, F.spark_partition_id()))


def _following(n: int, order: Window) -> Column:
    return F.filter(F.array(*[F.lead("i", k).over(order) for k in range(1, n + 1)]), lambda x: x.isNotNull())


def copies(numbered: DataFrame, limit: int) -> DataFrame:
    """Per profile: its position among the copies of its text and the next ``limit`` copies."""
    parts = in_range_parts(numbered.select("i", "text"), "part")
    whole = Window.partitionBy("text", "part")
    inside = parts.withColumns(
        {
            "place": F.row_number().over(whole.orderBy("i")) - 1,
            "size": F.count(F.lit(1)).over(whole),
            "next": _following(limit, whole.orderBy("i")),
        }
    )
    # texts cut by a part border: the first and last few of each part see each other here
    spans = parts.groupBy("text", "part").agg(F.count(F.lit(1)).alias("rows"))
    over_text = Window.partitionBy("text").orderBy("part")
    shifts = spans.select(
        "text",
        "part",
        F.coalesce(F.sum("rows").over(over_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"),
        F.count(F.lit(1)).over(Window.partitionBy("text")).alias("parts"),
    ).where("parts > 1")
    # a part border cuts one text at most, so there are at most two such rows per partition
    placed = inside.join(F.broadcast(shifts), ["text", "part"], "left")
    edge = placed.where(F.col("parts").isNotNull() & ((F.col("place") < limit) | (F.col("size") - F.col("place") <= limit)))
    across = edge.select("i", "place", "size", _following(limit, Window.partitionBy("text").orderBy("i")).alias("next_across"))
    across = across.where(F.col("size") - F.col("place") <= limit).select("i", "next_across")
    return placed.join(across, "i", "left").select(
        "i",
        "text",
        "part",
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("position"),
        F.coalesce("next_across", "next").alias("next"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
    )


def cross_matches(members: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """Matches with other texts, (i, j, score), for profiles whose copies leave room for them.

    A profile looks for the first copies after it of each similar text. That is found by
    sorting the profile in among them, part by part."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    room = F.lit(limit) - F.size("next")
    asking = members.where(room > 0).select("i", "text", room.alias("room"))
    asking = asking.join(both.withColumnRenamed("a", "text"), "text").select(
        F.col("b").alias("text"), "i", "room", "score", F.lit(None).cast("array<bigint>").alias("chain")
    )
    counts = members.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    partnered = both.select(F.col("a").alias("text")).distinct()
    asked = skew_join(members, partnered, "text", "i", "inner", heaviest(counts, "text", "n")).select(
        "text",
        "i",
        F.lit(None).cast("int").alias("room"),
        F.lit(None).cast("double").alias("score"),
        F.slice(F.concat(F.array("i"), "next"), 1, limit).alias("chain"),
    )
    mixed = in_range_parts(asking.unionByName(asked), "part")
    # walking backwards, the copy seen last is the first one after the current row
    back = Window.partitionBy("text", "part").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    found = mixed.withColumn("after", F.last("chain", ignorenulls=True).over(back)).where("room IS NOT NULL")
    heads = mixed.groupBy("text", "part").agg(F.min_by("chain", F.when(F.col("chain").isNotNull(), F.col("i"))).alias("head"))
    later = Window.partitionBy("text").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("text", "part", F.last("head", ignorenulls=True).over(later).alias("next_part"))
    chain = F.coalesce("after", "next_part")
    matches = (
        found.join(heads, ["text", "part"], "left")
        .select("i", "room", "score", F.explode(F.slice(chain, F.lit(1), F.col("room"))).alias("j"))
    )
    best = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    return (
        matches.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= F.col("room"))
        .select("i", "j", "score")
    )


def _step(carry: int, mark: int, limit: int) -> tuple[bool | None, int]:
    """Next copy of a text: carry is how many of the coming copies are already claimed."""
    if carry == UNKNOWN:
        return None, UNKNOWN
    if carry > 0:
        return False, carry - 1
    if mark == OPEN:
        return None, UNKNOWN
    return (True, limit) if mark == CLEAR else (False, 0)


def _runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for pdf in batches:
        yield from zip(*[pdf[c].tolist() for c in columns])


def _transfer(limit: int):
    """Per part of a text: the carry it leaves for each carry it may be entered with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, carries, rows = None, [], []
        for text, part, mark in _runs(batches, ["text", "part", "mark"]):
            if (text, part) != key:
                if key is not None:
                    rows.append((*key, carries))
                key, carries = (text, part), list(range(limit + 1))
            carries = [_step(c, mark, limit)[1] for c in carries]
        if key is not None:
            rows.append((*key, carries))
        yield pd.DataFrame(rows, columns=["text", "part", "leaves"])

    return run


def _entering():
    """Per part of a text: the carry it is entered with, following the parts in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, carry, rows = None, 0, []
        for text, part, leaves in _runs(batches, ["text", "part", "leaves"]):
            if text != current:
                current, carry = text, 0
            rows.append((text, part, carry))
            carry = UNKNOWN if carry == UNKNOWN else int(leaves[carry])
        yield pd.DataFrame(rows, columns=["text", "part", "enter"])

    return run


def _settle(limit: int):
    """Per copy: anchor, not anchor, or not known yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, carry = None, 0
        for pdf in batches:
            states = []
            for text, part, mark, enter in zip(pdf["text"], pdf["part"], pdf["mark"], pdf["enter"]):
                if (text, part) != key:
                    key, carry = (text, part), int(enter)
                anchor, carry = _step(carry, int(mark), limit)
                states.append(anchor)
            yield pdf[["i", "text", "part", "parts"]].assign(anchor=pd.array(states, dtype="boolean"))

    return run


def _in_order(df: DataFrame) -> DataFrame:
    """Whole (text, part) runs per partition, in order. Hashing them to one value keeps this
    shuffle apart from any the joins before it asked for, which may be read out of place."""
    return (
        df.withColumn("slot", F.xxhash64("text", "part"))
        .repartition("slot")
        .sortWithinPartitions("text", "part", "i")
        .drop("slot")
    )


def _settle_round(marked: DataFrame, limit: int) -> DataFrame:
    """One pass over the copies in order, given what is known about outside claims."""
    leaves = (
        _in_order(marked.where("parts > 1"))
        .select("text", "part", "mark")
        .mapInPandas(_transfer(limit), "text string, part int, leaves array<int>")
    )
    enter = (
        leaves.repartition("text").sortWithinPartitions("text", "part").mapInPandas(_entering(), "text string, part int, enter int")
    )
    entered = marked.join(enter, ["text", "part"], "left").withColumn("enter", F.coalesce("enter", F.lit(0)))
    return (
        _in_order(entered)
        .select("i", "text", "part", "parts", "mark", "enter")
        .mapInPandas(_settle(limit), "i bigint, text string, part int, parts bigint, anchor boolean")
    )


def anchors(members: DataFrame, matches: DataFrame, limit: int) -> DataFrame:
    """Who claims: one column ``i``.

    Copies that no other text matches repeat with a period of limit + 1. The others are
    settled in rounds; each round carries every text as far as its outside claims are known."""
    targets = matches.select(F.col("j").alias("i")).distinct()
    touched_texts = members.join(targets, "i", "left_semi").select("text").distinct().withColumn("touched", F.lit(True))
    counts = members.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    hot = heaviest(counts, "text", "n")
    flagged = materialize(skew_join(members.drop("next"), touched_texts, "text", "i", "left", hot))
    quiet = flagged.where("touched IS NULL").select("i", (F.col("position") % (limit + 1) == 0).alias("anchor"))
    touched = flagged.where("touched").select("i", "text", "part", "parts")

    from_quiet = matches.join(quiet, "i")
    pushed = from_quiet.where("anchor").select(F.col("j").alias("i")).distinct().withColumn("pushed", F.lit(True))
    links = materialize(matches.select("i", "j").join(touched.select("i"), "i", "left_semi"))
    state = materialize(
        touched.join(pushed, "i", "left").select(
            "i", "text", "part", "parts", F.coalesce("pushed", F.lit(False)).alias("pushed"), F.lit(None).cast("boolean").alias("anchor")
        )
    )
    fixed = state.select("i", "pushed")
    while True:
        outside = (
            links.join(state.select("i", "anchor"), "i")
            .groupBy(F.col("j").alias("i"))
            .agg(F.max(F.coalesce("anchor", F.lit(False))).alias("claimed"), F.max(F.col("anchor").isNull()).alias("open"))
        )
        mark = (
            F.when(F.col("pushed") | F.coalesce("claimed", F.lit(False)), MARKED)
            .when(F.coalesce("open", F.lit(False)), OPEN)
            .otherwise(CLEAR)
        )
        marked = state.drop("anchor", "pushed").join(fixed, "i").join(outside, "i", "left").withColumn("mark", mark)
        state = materialize(_settle_round(marked, limit))
        if state.where("anchor IS NULL").isEmpty():
            break
    return quiet.where("anchor").select("i").unionByName(state.where("anchor").select("i"))


def fuzzy_claims(numbered: DataFrame, cfg: RiskConfig) -> tuple[DataFrame, DataFrame]:
    """Claims that would be made (i, j, score) as members with their next copies, and matches."""
    texts = numbered.select("text").distinct()
    members, pairs = together(
        numbered.sparkSession,
        lambda: materialize(copies(numbered, cfg.fuzzy_limit)),
        lambda: materialize(similar_pairs(texts, cfg.fuzzy_threshold)),
    )
    return members, materialize(cross_matches(members, pairs, cfg.fuzzy_limit))


def first_texts(numbered: DataFrame) -> DataFrame:
    """(text, first): each text and the number of its first profile."""
    return numbered.groupBy("text").agg(F.min("i").alias("first"))


def anchor_texts(firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts (text, first) that become anchors when claims have no limit: in order of ``first``,
    those without an earlier anchor among the texts similar to them.

    Per round every text is settled whose earlier neighbours are; only open texts are carried on."""
    a, b = firsts.toDF("a", "first_a"), firsts.toDF("b", "first_b")
    turned = F.col("first_a") < F.col("first_b")
    before = pairs.join(a, "a").join(b, "b").select(
        F.when(turned, F.col("b")).otherwise(F.col("a")).alias("text"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("by")
    )
    links = materialize(before)
    waiting = links.select("text").distinct()
    found = materialize(firsts.join(waiting, "text", "left_anti").select("text"))
    anchors, fresh = [found], found
    while not links.isEmpty():
        # texts next to a new anchor are claimed; the links of claimed texts bind nobody any more
        claimed = materialize(links.join(fresh.withColumnRenamed("text", "by"), "by", "left_semi").select("text").distinct())
        links_left = links.join(claimed, "text", "left_anti")
        rest = materialize(links_left.join(claimed.withColumnRenamed("text", "by"), "by", "left_anti"))
        free = links_left.select("text").distinct().join(rest.select("text").distinct(), "text", "left_anti")
        fresh = materialize(free)
        anchors.append(fresh)
        links = rest
    every = anchors[0]
    for more in anchors[1:]:
        every = every.unionByName(more)
    return firsts.join(every, "text", "left_semi")


def link_without_limit(numbered: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sender_id, parent_id) when an anchor claims every later match."""
    leads = materialize(anchor_texts(materialize(first_texts(numbered)), pairs))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(leads.withColumnRenamed("text", "a"), "a").select(F.col("b").alias("text"), "first")
    reach = materialize(near.unionByName(leads.select("text", "first")))
    # a text's profiles are brought down to one row per account before they meet the anchors
    senders = numbered.groupBy("text", "sender_id").agg(F.max("i").alias("last"))
    hot = heaviest(senders.groupBy("text").agg(F.count(F.lit(1)).alias("n")), "text", "n")
    claims = skew_join(senders, reach, "text", "sender_id", "inner", materialize(hot)).where(F.col("first") < F.col("last"))
    last = claims.groupBy("sender_id").agg(F.max("first").alias("i"))
    return last.join(numbered.select("i", F.col("sender_id").alias("parent_id")), "i").select("sender_id", "parent_id")


def fuzzy_edges(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Every claim a profile would make: (profile_id, match_id, score), best ``fuzzy_limit`` per profile."""
    if cfg.fuzzy_limit is None:
        raise ValueError("claims without a limit aren't listed one by one: use fuzzy_link, or similar_pairs for the texts")
    numbered = materialize(numbered_profiles(distinct_profiles(df), cfg.fuzzy_scorer))
    members, matches = fuzzy_claims(numbered, cfg)
    same = members.select("i", F.explode("next").alias("j"), F.lit(100.0).alias("score"))
    edges = same.unionByName(matches)
    named = numbered.select("i", "sender_id")
    return (
        edges.join(named.withColumnRenamed("sender_id", "profile_id"), "i")
        .join(named.select(F.col("i").alias("j"), F.col("sender_id").alias("match_id")), "j")
        .select("profile_id", "match_id", "score")
    )


def fuzzy_link(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(sender_id, parent_id) for every account another one claimed."""
    numbered = materialize(numbered_profiles(distinct_profiles(df), cfg.fuzzy_scorer))
    if cfg.fuzzy_limit is None:
        return link_without_limit(numbered, materialize(similar_pairs(numbered.select("text").distinct(), cfg.fuzzy_threshold)))
    members, matches = fuzzy_claims(numbered, cfg)
    claiming = materialize(anchors(members, matches, cfg.fuzzy_limit))
    same = members.select("i", F.explode("next").alias("j"))
    claims = same.unionByName(matches.select("i", "j")).join(claiming, "i", "left_semi")
    named = numbered.select("i", "sender_id")
    last = (
        claims.join(named.select(F.col("i").alias("j"), "sender_id"), "j")
        .groupBy("sender_id")
        .agg(F.max("i").alias("i"))
    )
    return last.join(named.withColumnRenamed("sender_id", "parent_id"), "i").select("sender_id", "parent_id")

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators import entities, linking
from riskweave.operators.similarity_join import _meeting, gridded, length_pairs, similar_pairs
from tests.conftest import at

CFG = RiskConfig(fuzzy_limit=5)
FREE = RiskConfig()
T0 = at("2026-01-01 00:00:00")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def is_close(a, b, threshold):
    total = len(a) + len(b)
    return total - 2 * lcs(a, b) <= int(total * (100 - threshold) / 100 + 1e-9)


def in_turn(profiles, threshold, limit):
    """The linking one profile at a time."""
    names = [" ".join(sorted(n.split())) for _, n in profiles]
    taken, parents = set(), {}
    for i, (uid, _) in enumerate(profiles):
        if i in taken:
            continue
        found = []
        for j in range(i + 1, len(names)):
            if is_close(names[i], names[j], threshold):
                found.append((-2 * lcs(names[i], names[j]) / max(1, len(names[i]) + len(names[j])), j))
        for _, j in sorted(found)[:limit]:
            parents[profiles[j][0]] = uid
            taken.add(j)
    return parents


def table(spark, rows):
    return spark.createDataFrame(rows, "sender_id string, sender_name string, timestamp timestamp_ntz")


def named(spark, names):
    return table(spark, [(f"u{k:03d}", n, T0 + timedelta(seconds=k)) for k, n in enumerate(names)])


def links(df, cfg=CFG):
    return {r.sender_id: r.parent_id for r in linking.fuzzy_link(df, cfg).collect()}


def test_word_order_and_case(spark):
    assert links(named(spark, ["John Doe", "Doe John", "john doe"])) == {"u001": "u000"}


def test_five_matches_per_anchor(spark):
    got = links(named(spark, ["Ann Lee"] * 7))
    assert got == {f"u{k:03d}": "u000" for k in range(1, 6)}


@pytest.fixture(params=["2", "1000000"])
def common(request, spark):
    """Nearly every piece taken for a common one, or none."""
    spark.conf.set("spark.riskweave.commonPieceTexts", request.param)
    yield
    spark.conf.unset("spark.riskweave.commonPieceTexts")


@pytest.fixture(params=["3", "4000"])
def cells(request, spark):
    """Nearly every key cut into cells, or none."""
    spark.conf.set("spark.riskweave.cellRows", request.param)
    yield
    spark.conf.unset("spark.riskweave.cellRows")


@pytest.mark.parametrize("threshold", [85.0, 70.0, 55.0])
def test_similar_pairs_miss_nothing(spark, threshold, common, cells):
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 9))) for _ in range(160)})
    got = [frozenset((r.a, r.b)) for r in similar_pairs(spark.createDataFrame([(w,) for w in words], "text string"), threshold).collect()]
    expected = {frozenset((a, b)) for k, a in enumerate(words) for b in words[k + 1 :] if is_close(a, b, threshold)}
    assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("seed", [0, 1])
def test_linking_equals_one_at_a_time(spark, skew, seed):
    """Popular names, near copies, accounts with several names, equal times."""
    rnd = random.Random(seed)
    base = ["john doe", "doe john", "jon doe", "jhon doe", "mary smith", "mary smyth", "mari smith", "smith mary", "a b", "ab c"]
    rows = [
        (f"u{rnd.randint(0, 130):03d}", rnd.choice(base[: rnd.randint(1, 10)]), T0 + timedelta(seconds=rnd.randint(0, 40)))
        for _ in range(150)
    ]
    first = {}
    for u, n, t in rows:
        first[(u, n)] = min(t, first.get((u, n), t))
    profiles = sorted(first, key=lambda p: (first[p], *p))
    assert links(table(spark, rows).repartition(5)) == in_turn(profiles, 85.0, 5)
    assert links(table(spark, rows).repartition(5), FREE) == in_turn(profiles, 85.0, None)


def test_all_copies_are_one_entity_without_a_limit(spark):
    assert links(named(spark, ["Ann Lee"] * 7), FREE) == {f"u{k:03d}": "u000" for k in range(1, 7)}


def test_no_cell_gets_more_than_its_share(spark):
    """A key that every text holds: 500 by 500 rows in cells of about 50 by 50, each pair in one of them."""
    rows = spark.range(500).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("text"))
    index, probe = gridded(rows, rows, ["key"], 50)
    on = ["key", "row", "column"]
    met = index.withColumnRenamed("text", "a").join(probe.withColumnRenamed("text", "b"), on)
    assert met.count() == 250_000 and met.select("a", "b").distinct().count() == 250_000
    most = met.groupBy(*on).count().agg(F.max("count")).first()[0]
    assert most <= 4 * 50 * 50


def test_national_id(spark, skew):
    rows = [("N1", "u2"), ("N1", "u1"), ("N2", "u2"), ("N2", "u3"), (None, "u8"), (None, "u9"), ("N3", "u5")]
    df = spark.createDataFrame(rows, "sender_national_id string, sender_id string")
    got = {r.sender_id: r.primary_id for r in entities.link_national_id(df).collect()}
    assert got == {"u1": "u1", "u2": "u2", "u3": "u2"}


def test_name_link_is_looked_up_for_the_primary_once(spark, skew):
    rows = [("b", "x1", "I1"), ("c", "x2", "I1"), ("z", "x3", "I9")]
    df = spark.createDataFrame(rows, "sender_id string, sender_name string, sender_national_id string")
    names = spark.createDataFrame([("b", "a"), ("a", "q")], "sender_id string, parent_id string")
    got = {r.sender_id: r.global_entity_id for r in entities.account_entities(df, CFG, names).collect()}
    assert got == {"b": "a", "c": "a", "z": "z"}


def test_unknown_scorer(spark):
    with pytest.raises(ValueError):
        linking.fuzzy_link(named(spark, ["a"]), CFG.with_options({"fuzzy_scorer": "nope"}))


@pytest.mark.parametrize("most", ["0", "30", "600"])
def test_similar_pairs_by_subsequences_or_pieces(spark, most):
    """Every pair of lengths joined by pieces, some, or nearly all by subsequences: the same pairs."""
    spark.conf.set("spark.riskweave.subsequences", most)
    try:
        rnd = random.Random(2)
        base = ["".join(rnd.choice("aabé ") for _ in range(rnd.randint(0, 17))) for _ in range(60)]
        words = set(base)
        for w in base:
            for _ in range(2):
                cut = [c for c in w if rnd.random() > 0.1]
                cut.insert(rnd.randint(0, len(cut)), rnd.choice("abx"))
                words.add("".join(cut))
        words = sorted(words)
        df = spark.createDataFrame([(w,) for w in words] + [(None,)], "text string")
        got = [frozenset((r.a, r.b)) for r in similar_pairs(df, 85.0).collect()]
    finally:
        spark.conf.unset("spark.riskweave.subsequences")
    expected = {frozenset((a, b)) for k, a in enumerate(words) for b in words[k + 1 :] if is_close(a, b, 85.0)}
    assert len(got) == len(set(got)) and set(got) == expected


def test_names_that_share_a_part_do_not_all_meet(spark):
    """3,000 different names with the same first half: what is compared follows the names, not their pairs."""
    spark.conf.set("spark.riskweave.commonPieceTexts", "1000000")
    try:
        rows = spark.range(3000).select(F.concat(F.lit("maximilian "), F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 4)).alias("text")).distinct()
        rows = rows.withColumn("id", F.monotonically_increasing_id()).localCheckpoint()
        met = _meeting(rows, length_pairs(rows, 95.0, 600), 4000)
        assert length_pairs(rows, 95.0, 600).where("by_parts").isEmpty()
        assert met.count() <= 0.05 * rows.count() ** 2 / 2
    finally:
        spark.conf.unset("spark.riskweave.commonPieceTexts")

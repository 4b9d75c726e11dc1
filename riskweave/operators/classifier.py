"""Supervised reporting probability with gradient-boosted trees."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.numeric import round_half_even
from ..schema import LABEL
from ..session import materialize
from .features import SUPERVISED_FEATURES, feature

PREFIX = "_f_"


@dataclass
class Training:
    model: PipelineModel
    accuracy: float
    area_under_pr: float


def _inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({PREFIX + n: feature(df, n) for n in SUPERVISED_FEATURES})


def split_by_hash(df: DataFrame, cfg: RiskConfig, held_out: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """A split that does not depend on how the rows are spread over partitions."""
    columns = ["transaction_id"] if "transaction_id" in df.columns else df.columns
    text = F.concat_ws("|", F.lit(str(cfg.seed)), *[F.col(c).cast("string") for c in columns])
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    marked = df.withColumn("_draw", F.pmod(draw, F.lit(10_000)))
    cut = int(held_out * 10_000)
    return marked.where(F.col("_draw") >= cut).drop("_draw"), marked.where(F.col("_draw") < cut).drop("_draw")


#: Draws are grouped by their top bits to find each class's cut; only the rows of the cut's group are ranked.
DRAW_BITS, BUCKET_BITS = 32, 16


def split_by_class(df: DataFrame, cfg: RiskConfig, label: str = LABEL, held_out: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Hold out exactly ``floor(held_out * n + 0.5)`` rows of each class: those first by md5 draw, then transaction_id.

    Counts per class and draw group (at most 2^16 groups a class) find the group that holds each class's cut; the
    rows below it are held out, and the rows of that group are ranked by a window over it alone, so no class is ever
    gathered into one task. A null label is a class of its own."""
    ids = ["transaction_id"] if "transaction_id" in df.columns else df.columns
    text = F.concat_ws("|", F.lit(str(cfg.seed)), *[F.col(c).cast("string") for c in ids])
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")
    marked = df.withColumns({"_draw": draw, "_class": F.col(label).cast("string")})
    marked = marked.withColumn("_bucket", F.shiftright("_draw", DRAW_BITS - BUCKET_BITS))
    counts = marked.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    totals: dict = {}
    for r in counts:
        totals.setdefault(r["_class"], []).append((r["_bucket"], r["n"]))
    cuts = []
    for name, buckets in totals.items():
        want = int(held_out * sum(n for _, n in buckets) + 0.5)
        below = 0
        for bucket, n in sorted(buckets):
            if below + n >= want:
                cuts.append((name, int(bucket), want - below))
                break
            below += n
    schema = "_class string, _cut long, _need long"
    cut = F.broadcast(df.sparkSession.createDataFrame(cuts or [], schema))
    met = marked.join(cut, marked["_class"].eqNullSafe(cut["_class"]), "left").drop(cut["_class"])
    edge = met.where(F.col("_bucket") == F.col("_cut"))
    order = Window.partitionBy("_class", "_bucket").orderBy("_draw", *ids)
    edge = edge.withColumn("_held", F.row_number().over(order) <= F.col("_need"))
    rest = met.where(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut"))).withColumn(
        "_held", F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False))
    )
    both = edge.unionByName(rest)
    helper = ["_draw", "_class", "_bucket", "_cut", "_need", "_held"]
    return both.where(~F.col("_held")).drop(*helper), both.where(F.col("_held")).drop(*helper)


#: Bins of a feature, and rows from which Spark's fit finds their borders in a sample: its defaults.
BINS, BORDER_ROWS = 32, 10_000
#: Grouped rows in a partition, at most on average.
PART_ROWS = 500_000


def borders(values: list[tuple[float, int]], bins: int) -> list[float]:
    """Thresholds between counted values, by the rule of Spark's trees: midpoints where a bin's share of the rows is reached."""
    values = sorted(values)
    middle = [(a + b) / 2 for (a, _), (b, _) in zip(values, values[1:], strict=False)]
    if len(middle) >= bins:
        stride = sum(n for _, n in values) / bins
        so_far, target, some = 0, stride, []
        for (_, n), (_, following), between in zip(values, values[1:], middle, strict=False):
            so_far += n
            if abs(so_far - target) < abs(so_far + following - target):
                some.append(between)
                target += stride
        middle = some
    return sorted({t for t in middle if t < math.inf})


def drawn_borders(training: DataFrame, column: str, known: list[float], seed: int) -> list[float]:
    """The thresholds that Spark's fit draws for a feature of many rows: it samples rows by the seed and their layout only.

    A tree that learns the place of a value among ``known`` ones from the value alone splits at every threshold."""
    low = sorted(x for x in set(known) if -math.inf < x < math.inf)
    if len(low) < 2:
        return []
    steps = [
        Bucketizer(splits=[-math.inf, *low[1:], math.inf], inputCol=column, outputCol="_place"),
        VectorAssembler(inputCols=[column], outputCol="_value"),
        DecisionTreeRegressor(featuresCol="_value", labelCol="_place", maxBins=BINS, maxDepth=30, seed=seed),
    ]
    tree = Pipeline(stages=steps).fit(training.select(column)).stages[-1]
    return sorted({float(t) for t in re.findall(r"If \(feature 0 <= (\S+)\)", tree.toDebugString)})


def binned_by(training: DataFrame, columns: list[str], seed: int) -> Bucketizer:
    """The stage that replaces each feature by the number of its thresholds below it."""
    n = training.count()
    sample = training if n <= BORDER_ROWS else training.sample(BORDER_ROWS / n, seed)
    # a negative zero is a zero
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(c) + F.lit(0.0)).alias("x")) for k, c in enumerate(columns)]))
    found: list[list] = [[] for _ in columns]
    for r in sample.select(pairs.alias("v")).groupBy("v.k", "v.x").count().collect():
        found[r["k"]].append((r["x"], r["count"]))
    splits = []
    for c, values in zip(columns, found, strict=True):
        # a bucket starts at its lower end, a bin behind its threshold; a feature of one value needs some border above it
        inner = borders(values, min(BINS, n)) if n <= BORDER_ROWS else drawn_borders(training, c, [x for x, _ in values], seed)
        inner = inner or [max((x for x, _ in values if x < math.inf), default=0.0)]
        splits.append([-math.inf, *[math.nextafter(t, math.inf) for t in inner], math.inf])
    return Bucketizer(splitsArray=splits, inputCols=columns, outputCols=[c + "_bin" for c in columns])


def grouped(training: DataFrame, bins: Bucketizer) -> DataFrame:
    """Rows of equal bins and label as one, with their number as its weight.

    Trees see no more of a feature than its bin, and rows of equal bins and label have equal residuals in every round, so
    the sums are the same, over fewer rows. They are spread evenly, as each round passes over them once per level."""
    spark = training.sparkSession
    names = [*bins.getOutputCols(), "label"]
    # the bucketizer marks its columns as categories; these are ordered numbers, which a sum forgets
    rows = bins.transform(training).select(*[(F.col(c) + F.lit(0.0)).alias(c) for c in names[:-1]], "label").groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    rows = materialize(rows)
    cores = spark.sparkContext.defaultParallelism
    return materialize(rows.repartition(cores * (-(-rows.count() // (cores * PART_ROWS)) or 1), *names))


def train_classifier(df: DataFrame, cfg: RiskConfig, label: str = LABEL) -> Training:
    """Fit on 80 % of each class of the labelled rows, judge on the rest."""
    if label not in df.columns:
        raise ValueError(f"training needs the label column {label}")
    columns = [PREFIX + n for n in SUPERVISED_FEATURES]
    keep = ["transaction_id"] if "transaction_id" in df.columns else []
    rows = _inputs(df).select(*keep, *columns, F.col(label).cast("double").alias("label"))
    training, validation = split_by_class(materialize(rows), cfg, "label")
    training = materialize(training)
    bins = binned_by(training, columns, cfg.seed)
    steps = [
        VectorAssembler(inputCols=bins.getOutputCols(), outputCol="_features"),
        GBTClassifier(
            featuresCol="_features",
            labelCol="label",
            weightCol="_weight",
            maxBins=BINS,
            maxIter=cfg.boost_rounds,
            maxDepth=cfg.boost_depth,
            stepSize=cfg.boost_rate,
            seed=cfg.seed,
        ),
    ]
    fitted = Pipeline(stages=steps).fit(grouped(training, bins))
    model = PipelineModel([bins, *fitted.stages])
    judged = materialize(model.transform(validation).select("label", "prediction", "rawPrediction"))
    accuracy = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy").evaluate(judged)
    area = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderPR").evaluate(judged)
    return Training(model, accuracy, area)


def score_probability(df: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds ml_supervised_score, the label's probability in percent; 0 without a model."""
    if model is None:
        return df.withColumn("ml_supervised_score", F.lit(0.0))
    scored = model.transform(_inputs(df))
    probability = vector_to_array("probability")[1]
    return scored.withColumn("ml_supervised_score", round_half_even(probability * 100, 2)).select(
        *df.columns, "ml_supervised_score"
    )

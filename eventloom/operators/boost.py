"""Models of the residual and of the tail, weights of selection, applied and spliced as columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.rows import clip
from eventloom.operators import trees
from eventloom.operators.calib import mean_of

def _grown(train: DataFrame, features: list[str], y: Column, base: Column, held: str | None, settings: trees.Settings, models: list | None = None, member: Column | None = None, **kw) -> trees.Forest:
    member = F.array(F.lit(0)) if member is None else member
    return trees.fit(train, features, y, models or ["all"], member, settings=settings, base=base, held=F.col(held) if held else None, **kw)


def residual_boost(
    train: DataFrame, apply_to: DataFrame, features: list[str], y: str, base: str, name: str, held: str | None = None, seed: int = 1, settings: trees.Settings = trees.Settings()
) -> DataFrame:
    """Base prediction plus a boosted estimate of what it leaves over; ``held`` names a boolean column of rows kept for early stopping.

    With the quantile loss it is the quantile of y, with the Huber loss an estimate that far values pull no more than ``settings.at``.
    """
    forest = _grown(train, features, F.col(y), F.col(base), held, settings, seeds=[seed])
    return trees.predict(forest, apply_to, "_left").withColumn(name, F.col(base) + F.col("_left")).drop("_left")


def entity_experts(
    train: DataFrame, apply_to: DataFrame, entity: str, min_rows: int, features: list[str], y: str, base: str, name: str, held: str | None = None, settings: trees.Settings = trees.Settings()
) -> DataFrame:
    """A model of its own for every entity with enough rows, the pooled model for the rest; all of them grow in the same jobs.

    Rows without an entity have no expert. The entities with enough rows, at most rows / ``min_rows``, come to the driver.
    """
    counted = train.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    strong = sorted(r[entity] for r in counted.select(entity).collect())
    kind = train.schema[entity].dataType
    numbers = train.sparkSession.createDataFrame([(e, i + 1) for i, e in enumerate(strong)], f"_entity {kind.simpleString()}, _expert int")
    numbered = lambda df: df.join(numbers, df[entity] == numbers["_entity"], "left").drop("_entity")
    member = F.array_compact(F.array(F.lit(0), F.col("_expert")))
    forest = _grown(numbered(train), features, F.col(y), F.col(base), held, settings, ["pooled", *strong], member)
    got = trees.predict(forest, numbered(apply_to), "_left", F.coalesce("_expert", F.lit(0)))
    return got.withColumn(name, F.col(base) + F.col("_left")).drop("_left", "_expert")


def slice_specialist(
    train: DataFrame, apply_to: DataFrame, mask: Column, features: list[str], y: str, general: str, name: str, bounds: tuple[float, float] | None = None, held: str | None = None, settings: trees.Settings = trees.Settings()
) -> DataFrame:
    """A model around the slice's own mean for the masked rows, the general prediction elsewhere; ``bounds`` clips the specialist."""
    part = train.where(mask)
    centre = part.agg(F.avg(y)).scalar()
    special = residual_boost(part.withColumn("_centre", centre), apply_to.withColumn("_centre", centre), features, y, "_centre", "_special", held, settings=settings)
    chosen = clip(F.col("_special"), *bounds) if bounds else F.col("_special")
    return special.withColumn(name, F.when(mask, chosen).otherwise(F.col(general))).drop("_centre", "_special")


def balanced_weight(flag: Column, share: Column) -> Column:
    """Class weights that give both classes the same total."""
    return F.when(flag, F.lit(0.5) / share).otherwise(F.lit(0.5) / (F.lit(1.0) - share))


def tail_probability(train: DataFrame, apply_to: DataFrame, features: list[str], event: Column, name: str, held: str | None = None, settings: trees.Settings = trees.Settings()) -> DataFrame:
    """Probability of a rare event from balanced boosted trees with the logistic loss."""
    flagged = train.withColumn("_label", event.cast("double"))
    weight = balanced_weight(F.col("_label") == 1, flagged.agg(F.avg("_label")).scalar())
    forest = _grown(flagged, features, F.col("_label"), F.lit(0.0), held, replace(settings, loss="logistic"), weight=weight)
    return trees.predict(forest, apply_to, "_raw").withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_raw")))).drop("_raw")


def propensity(train: DataFrame, apply_to: DataFrame, features: list[str], event: Column, name: str) -> DataFrame:
    """Probability of selection from a logistic regression on standardised inputs; a missing input is its mean, with a flag beside it."""
    means = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()

    def filled(df: DataFrame) -> DataFrame:
        values = {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] or 0.0))) for c in features}
        flags = {f"_m_{c}": F.col(c).isNull().cast("double") for c in features}
        return VectorAssembler(inputCols=[*values, *flags], outputCol="_features").transform(df.withColumns(values | flags))

    model = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=50, standardization=True).fit(filled(train.withColumn("_label", event.cast("double"))))
    return model.transform(filled(apply_to)).select(*apply_to.columns, vector_to_array("probability")[1].alias(name))


def seed_average(
    train: DataFrame, apply_to: DataFrame, features: list[str], y: str, base: str, seeds: list[int], name: str, held: str | None = None, settings: trees.Settings = trees.Settings()
) -> DataFrame:
    """Mean prediction of the same model under several seeds, which grow in the same jobs."""
    member = F.array(*[F.lit(i) for i in range(len(seeds))])
    forest = _grown(train, features, F.col(y), F.col(base), held, settings, seeds, member, seeds=seeds)
    got = apply_to
    for i, s in enumerate(seeds):
        got = trees.predict(forest, got, f"_p{s}", F.lit(i))
    return got.withColumn(name, F.col(base) + mean_of([f"_p{s}" for s in seeds])).drop(*[f"_p{s}" for s in seeds])


def importance(train: DataFrame, features: list[str], y: str, base: str, classes: dict[str, str], held: str | None = None, settings: trees.Settings = trees.Settings()) -> list[tuple[str, str, float]]:
    """(feature, class, share of the gain) of a boosted model of the residual."""
    forest = _grown(train, features, F.col(y), F.col(base), held, settings)
    return [(f, classes.get(f, "other"), share) for f, share in trees.importance(forest).items()]

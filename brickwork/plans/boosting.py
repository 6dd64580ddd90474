"""Staged boosting with patience, and tree ensembles as one projection.

Each round fits one tree to the residuals of the training rows, adds its shrunk
prediction to a running column, and scores the held-out rows in the same pass.  The
fit ends after ``patience`` rounds without gain, and the ensemble keeps the trees up to
the best round.  The running column is cut from its lineage every ``refresh`` rounds.

An ensemble is an ordinary boosted model, so it is stored and applied as any other.  All
targets of a study share one vector of encoded features; the trees are evaluated by
generated code beside the rest of the projection, which keeps the partitioning of the
draws, so nothing is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwork.functions.text import derive
from brickwork.session import cut_lineage


@dataclass(frozen=True)
class Patience:
    """Settings of the staged fit; ``patience`` counts rounds without gain on the held-out rows."""

    rounds: int = 4000
    patience: int = 20
    depth: int = 5
    step: float = 0.1
    min_child: int = 3
    subsample: float = 0.8
    column_share: str = "0.8"
    seed: int = 42
    refresh: int = 16


@dataclass(frozen=True)
class TreeEnsemble:
    """``base`` plus boosted trees over encoded ``features``; without trees, ``base`` alone."""

    features: tuple[str, ...]
    base: float
    boosted: GBTRegressionModel | None

    @property
    def trees(self) -> list[DecisionTreeRegressionModel]:
        return list(self.boosted.trees) if self.boosted is not None else []


def boosted(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float]) -> GBTRegressionModel | None:
    """One boosted model of separately fitted trees."""
    if not trees:
        return None
    sc = spark.sparkContext
    own = sc._jvm.org.apache.spark.ml.regression
    parts = sc._gateway.new_array(own.DecisionTreeRegressionModel, len(trees))
    scales = sc._gateway.new_array(sc._gateway.jvm.double, len(trees))
    for k, (tree, weight) in enumerate(zip(trees, weights)):
        parts[k], scales[k] = tree._java_obj, float(weight)
    return GBTRegressionModel(own.GBTRegressionModel(f"staged_{uuid.uuid4().hex[:12]}", parts, scales))


def of_pipeline(model: PipelineModel) -> TreeEnsemble:
    """A fitted assembler and boosted regressor as a tree ensemble."""
    assembler, gbt = model.stages
    return TreeEnsemble(tuple(assembler.getInputCols()), 0.0, gbt)


def save_ensembles(models: Mapping[str, TreeEnsemble], spark: SparkSession, root: str) -> None:
    rows = [(t, list(m.features), m.base, m.boosted is not None) for t, m in models.items()]
    spark.createDataFrame(rows, "target string, features array<string>, base double, boosted boolean").coalesce(1).write.mode("overwrite").parquet(f"{root}/ensembles.parquet")
    for target, m in models.items():
        if m.boosted is not None:
            m.boosted.write().overwrite().save(f"{root}/{target}.trees")


def load_ensembles(spark: SparkSession, root: str) -> dict[str, TreeEnsemble]:
    rows = spark.read.parquet(f"{root}/ensembles.parquet").collect()  # one row per target
    return {
        r["target"]: TreeEnsemble(tuple(r["features"]), r["base"], GBTRegressionModel.load(f"{root}/{r['target']}.trees") if r["boosted"] else None)
        for r in rows
    }


def predict_trees(df: DataFrame, models: Mapping[str, TreeEnsemble], codes: Mapping[str, str], names: Mapping[str, str]) -> DataFrame:
    """``df`` with the prediction of every target as the column ``names[target]``.

    ``codes`` gives the encoded value of each feature as SQL text over ``df``; a missing
    value goes right at every split.
    """
    features = {m.features for m in models.values()}
    if len(features) != 1:
        raise ValueError("the ensembles must share their features")
    (order,) = features
    keep = [c for c in df.columns if c not in names.values()]
    own = [f"__code_{k}" for k in range(len(order))]
    coded = derive(df, {o: f"double({codes[f]})" for o, f in zip(own, order)})
    out = VectorAssembler(inputCols=own, outputCol="__features", handleInvalid="keep").transform(coded).drop(*own)
    made = {}
    for k, (target, m) in enumerate(models.items()):
        made[names[target]] = f"{m.base!r}D"
        if m.boosted is not None:
            out = m.boosted.copy({m.boosted.featuresCol: "__features", m.boosted.predictionCol: f"__tree_{k}"}).transform(out)
            made[names[target]] += f" + __tree_{k}"
    return out.selectExpr(*[f"`{c}`" for c in keep], *[f"{text} AS `{n}`" for n, text in made.items()])


@dataclass(frozen=True)
class Staged:
    """A fitted ensemble, and (round, error on training rows, error on held-out rows) of every round."""

    model: TreeEnsemble
    history: tuple[tuple[int, float, float | None], ...]

    @property
    def best(self) -> int:
        return len(self.model.trees)

    def table(self, spark: SparkSession, target: str) -> DataFrame:
        rows = [(target, r, train, held, r == self.best) for r, train, held in self.history]
        return spark.createDataFrame(rows, "target string, round int, train_rmse double, held_rmse double, chosen boolean")


def fit_staged(rows: DataFrame, features: Sequence[str], target: str, p: Patience = Patience(), held: str = "__held") -> Staged:
    """Boost one regressor over encoded ``rows``; rows with a true ``held`` only decide when to stop.

    Without held-out rows every round is kept.  Rows without a target value or without
    one of the features are left out; without training rows the ensemble is its base, 0.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip")
    own = assembler.transform(rows.filter(F.col(target).isNotNull()))
    own = own.select("__x", F.col(target).cast("double").alias("__y"), F.coalesce(held, F.lit(False)).alias("__h")).persist()
    base = own.filter("NOT __h").agg(F.avg("__y")).first()[0]
    state, kept = own.withColumn("__f", F.lit(base or 0.0)), None
    squared = (F.col("__y") - F.col("__f")) ** 2
    error = lambda h: F.sqrt(F.avg(F.when(F.col("__h") == F.lit(h), squared)))
    trees: list = []
    history: list[tuple[int, float, float | None]] = []
    best = 0
    for r in range(1, p.rounds + 1 if base is not None else 1):
        fitter = RandomForestRegressor(
            featuresCol="__x", labelCol="__r", predictionCol="__t", numTrees=1, bootstrap=False, subsamplingRate=p.subsample,
            featureSubsetStrategy=p.column_share, maxDepth=p.depth, minInstancesPerNode=p.min_child, seed=p.seed + r,
        )
        fitted = fitter.fit(state.filter("NOT __h").select("__x", (F.col("__y") - F.col("__f")).alias("__r")))
        trees.append(fitted.trees[0])
        state = fitted.transform(state).withColumn("__f", F.col("__f") + F.lit(p.step) * F.col("__t")).select("__x", "__y", "__h", "__f")
        if r % p.refresh == 0:
            state, old = cut_lineage(state).persist(), kept
            kept = state
            if old is not None:
                old.unpersist()
        scores = state.agg(error(False).alias("train"), error(True).alias("held")).first()
        history.append((r, scores["train"], scores["held"]))
        if scores["held"] is None or best == 0 or scores["held"] < history[best - 1][2]:
            best = r
        if r - best >= p.patience:
            break
    for cached in (own, kept):
        if cached is not None:
            cached.unpersist()
    model = TreeEnsemble(tuple(features), base or 0.0, boosted(rows.sparkSession, trees[:best], [p.step] * best))
    return Staged(model, tuple(history))

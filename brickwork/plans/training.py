"""Surrogate regressors: cross-validated folds, persistence, progressive loop."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwork.functions.rng import with_row_key
from brickwork.operators import surrogate as s
from brickwork.operators.energy import cooling_for_prediction, reader
from brickwork.operators.ranking import hash_rank, split_label, stratified_folds
from brickwork.operators.sampling import stratified_selection
from brickwork.operators.validation import near_constant_columns
from brickwork.plans.boosting import Patience, Staged, TreeEnsemble, fit_staged, load_ensembles, of_pipeline, predict_trees, save_ensembles
from brickwork.session import cut_lineage
from brickwork.sources.tables import write_stage

Model = PipelineModel | TreeEnsemble


@dataclass(frozen=True)
class Boosting:
    """Settings of the boosted trees; early stop compares against the test split."""

    rounds: int = 100
    depth: int = 5
    step: float = 0.1
    min_child: int = 3
    subsample: float = 0.8
    column_share: str = "0.8"
    tolerance: float = 1e-4
    seed: int = 42


@dataclass
class FoldResult:
    models: dict[str, Model] = field(default_factory=dict)
    space: s.FeatureSpace | None = None
    predictions: DataFrame | None = None
    metrics: DataFrame | None = None
    encoded: DataFrame | None = None
    stages: dict[str, Staged] = field(default_factory=dict)

    def release(self) -> None:
        """Give back the cached rows once the metrics are stored."""
        if self.encoded is not None:
            self.encoded.unpersist()


CONCURRENT_FITS = 4


def _together(spark: SparkSession, jobs: Sequence[Callable[[], object]]) -> list:
    """Run independent fits side by side; each is a chain of short Spark jobs."""
    with ThreadPoolExecutor(CONCURRENT_FITS) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [f.result() for f in futures]


def assign_folds(data: DataFrame, stratum: str, key: Sequence[str], folds: int, seed: int = 42) -> DataFrame:
    """Rows with their fold, ranked once: every fit and every fold reads them several times."""
    rows, keyed = with_row_key(data, seed, key)
    return cut_lineage(stratified_folds(rows, [stratum], keyed.uniform("order"), list(key), folds).drop(*keyed.columns()))


def fit_target(train: DataFrame, features: Sequence[str], target: str, b: Boosting) -> PipelineModel:
    """One regressor; ``__held`` marks validation rows."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep")
    gbt = GBTRegressor(
        featuresCol="__x", labelCol=target, predictionCol=f"pred_{target}", maxIter=b.rounds, maxDepth=b.depth, stepSize=b.step,
        minInstancesPerNode=b.min_child, subsamplingRate=b.subsample, featureSubsetStrategy=b.column_share, seed=b.seed,
        validationIndicatorCol="__held", validationTol=b.tolerance,
    )
    return Pipeline(stages=[assembler, gbt]).fit(train)


def predict(df: DataFrame, models: Mapping[str, Model]) -> DataFrame:
    """Every target's prediction as ``pred_<target>``; ``df`` is encoded."""
    trees = {t: m for t, m in models.items() if isinstance(m, TreeEnsemble)}
    for target, model in models.items():
        if target not in trees:
            df = model.transform(df).drop("__x")
    if not trees:
        return df
    features = next(iter(trees.values())).features
    return predict_trees(df, trees, {f: f"`{f}`" for f in features}, {t: f"pred_{t}" for t in trees})


def trained_predictor(models: Mapping[str, Model], space: s.FeatureSpace, rename: Mapping[str, str] | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """Trained models as the load function of an inference plan.

    Features are read as the scenario sees them; buildings without cooling are
    predicted as if they had central cooling.  All targets come out of one projection
    over the draws.  ``rename`` maps a target to its raw load column.
    """
    trees = {t: m if isinstance(m, TreeEnsemble) else of_pipeline(m) for t, m in models.items()}

    def loads(df: DataFrame, suffix: str = "") -> DataFrame:
        cooled = cooling_for_prediction(df, suffix) if "semantic__Cooling" in space.features else df
        c = reader(cooled, suffix)
        read = lambda f: "`predict__Cooling`" if f == "semantic__Cooling" else c(f)
        names = {t: (rename or {}).get(t, t) + suffix for t in trees}
        return predict_trees(cooled, trees, space.codes(read), names).drop("predict__Cooling")

    return loads


def split_target_names(df: DataFrame, targets: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, measurement, target, target_value, prediction) from wide columns."""
    items = ", ".join(
        f"struct('{t.split('_', 1)[0]}' AS measurement, '{t.split('_', 1)[-1]}' AS target, double(`{t}`) AS target_value, `pred_{t}` AS prediction)" for t in targets
    )
    return df.selectExpr(*keys, f"inline(array({items}))")


def train_fold(
    data: DataFrame, fold: int, features: Sequence[str], categorical: Sequence[str], targets: Sequence[str], stratum: str, *, iteration: int = 0, boosting: Boosting | Patience = Boosting()
) -> FoldResult:
    """Split, learn the space on the training rows, encode, fit, score; ``Patience`` settings fit in stages."""
    tagged = data.withColumn("split", split_label(F.col("fold"), fold))
    space = s.learn_space(tagged, tagged.filter("split = 'train'"), features, categorical)
    named = tagged.withColumn("__stratum", F.col(stratum))
    encoded = space.encode(named, ["split", "__stratum", *targets])
    encoded = encoded.withColumn("__held", F.col("split") == "test").persist()
    encoded.count()  # cached once, then read by every target
    stages: dict[str, Staged] = {}
    if isinstance(boosting, Patience):
        jobs = [lambda t=t: fit_staged(encoded, features, t, boosting) for t in targets]
        stages = dict(zip(targets, _together(data.sparkSession, jobs)))
        models = {t: x.model for t, x in stages.items()}
    else:
        jobs = [lambda t=t: fit_target(encoded, features, t, boosting) for t in targets]
        models = dict(zip(targets, _together(data.sparkSession, jobs)))
    long = split_target_names(predict(encoded, models), targets, ["split", "__stratum"]).withColumnRenamed("__stratum", "stratum")
    scored = s.regression_metrics(long, ["split", "measurement", "target"], "stratum")
    metrics = s.long_metrics(scored, ["split", "measurement", "target", "stratum"]).withColumns({"fold": F.lit(fold), "iteration": F.lit(iteration)})
    return FoldResult(models, space, long, metrics, encoded, stages)


def cross_validate(data: DataFrame, folds: int, **kw) -> tuple[list[FoldResult], DataFrame]:
    jobs = [lambda i=i: train_fold(data, i, **kw) for i in range(folds)]
    results = _together(data.sparkSession, jobs)
    metrics = results[0].metrics
    for r in results[1:]:
        metrics = metrics.unionByName(r.metrics)
    return results, metrics


def save_models(result: FoldResult, spark: SparkSession, root: str) -> None:
    trees = {t: m for t, m in result.models.items() if isinstance(m, TreeEnsemble)}
    for target, model in result.models.items():
        if target not in trees:
            model.write().overwrite().save(f"{root}/{target}.gbt")
    if trees:
        save_ensembles(trees, spark, root)
    result.space.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{root}/space.parquet")


def load_models(spark: SparkSession, root: str) -> tuple[dict[str, Model], s.FeatureSpace]:
    """Models of an experiment by suffix, staged ones from their table, and its feature space."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = sorted(x.getPath().getName() for x in listing)
    models: dict[str, Model] = {n.removesuffix(".gbt"): PipelineModel.load(f"{root}/{n}") for n in names if n.endswith(".gbt")}
    if "ensembles.parquet" in names:
        models |= load_ensembles(spark, root)
    if not models:
        raise ValueError(f"no models under {root}")
    return models, s.FeatureSpace.from_table(spark.read.parquet(f"{root}/space.parquet"))


@dataclass(frozen=True)
class Progress:
    """Sizes and stopping rule of the progressive study."""

    n_init: int = 10_000
    n_per_iter: int = 10_000
    min_per_stratum: int = 100
    max_iters: int = 100
    folds: int = 5
    thresholds: Mapping[str, float] = field(default_factory=lambda: dict(s.THRESHOLDS))


def progressive_training(
    population: DataFrame,
    key: str,
    field_name: str,
    simulate: Callable[[DataFrame, int], DataFrame],
    features: Sequence[str],
    categorical: Sequence[str],
    targets: Sequence[str],
    root: str,
    experiment_id: str,
    progress: Progress = Progress(),
    boosting: Boosting | Patience = Boosting(),
) -> DataFrame:
    """Sample, run, merge, cross-validate, until converged or out of iterations.

    Every stage ends in a written table, which both cuts the lineage and is the
    record of the study; a lost executor costs one stage at most.  Returns the
    fold-averaged metrics of all iterations with a ``converged`` flag each.
    """
    spark = population.sparkSession
    merged: DataFrame | None = None
    history: DataFrame | None = None
    for it in range(progress.max_iters):
        n = progress.n_init if it == 0 else progress.n_per_iter
        specs = stratified_selection(population, field_name, key, n, it, min_per_stratum=progress.min_per_stratum)
        specs = specs.withColumn("spec_id", F.concat_ws("/", F.lit(it), F.col(key), F.col("draw_id")))
        at = write_stage(specs, root, experiment_id, it, "specs")
        fresh = simulate(spark.read.parquet(at), it)
        both = fresh if merged is None else merged.unionByName(fresh, allowMissingColumns=True)
        merged = spark.read.parquet(write_stage(both, root, experiment_id, it, "full-dataset"))
        numeric = [f for f in features if f not in categorical]
        flat = set(near_constant_columns(merged, [*numeric, *targets]))
        data = assign_folds(merged, field_name, ["spec_id"], progress.folds)
        results, metrics = cross_validate(
            data, progress.folds, features=[f for f in features if f not in flat], categorical=categorical,
            targets=[t for t in targets if t not in flat], stratum=field_name, iteration=it, boosting=boosting,
        )
        average = s.fold_average(metrics.filter("stratum IS NOT NULL")).withColumn("iteration", F.lit(it))
        average = spark.read.parquet(write_stage(average, root, experiment_id, it, "fold-averaged-errors"))
        for r in results:
            r.release()
        done = bool(s.converged(s.converged_pairs(average, progress.thresholds)).first()["converged"])
        average = average.withColumn("converged", F.lit(done))
        history = average if history is None else history.unionByName(average)
        if done:
            break
    return history


def learning_curve(data: DataFrame, fractions: Sequence[float], key: Sequence[str], seed: int = 42, **kw) -> DataFrame:
    """Test metrics by share of the (shuffled) training rows used."""
    rows, keyed = with_row_key(data, seed, key)
    train = cut_lineage(hash_rank(rows.filter("fold <> 0"), [], keyed.uniform("order"), list(key), "__rank").drop(*keyed.columns()))
    test = data.filter("fold = 0")
    n = train.count()
    out = None
    for f in fractions:
        part = train.filter(F.col("__rank") <= int(f * n)).drop("__rank").unionByName(test)
        result = train_fold(part, 0, **kw)
        got = cut_lineage(result.metrics.withColumn("fraction", F.lit(float(f))))
        result.release()
        out = got if out is None else out.unionByName(got)
    return out

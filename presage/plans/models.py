"""Classifiers fitted with MLlib on a stored split."""

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.config import ENTITY, FEATURE_GROUPS, TASK_FEATURES, TASK_LABEL, check_feature_groups
from presage.operators.metrics import PROBABILITY_GRID, best_threshold, evaluate, threshold_sweep
from presage.operators.sampling import random_holdout, rank_by_hash, stratified_folds, stratified_holdout
from presage.operators.sequences import flat_vector
from presage.operators.split import balanced_weights
from presage.session import staged

SEED = 42
#: Fewer rows than this are no task of their own in the passes of a fit.
TASK_ROWS = 8192
#: Rows that the net takes as one matrix; MLlib's own number is 128.
NET_BLOCK = 512


@dataclass(frozen=True)
class TreeParams:
    """Boosting settings; ``patience`` is the validation tolerance for an early stop."""

    trees: int = 500
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    patience: float = 0.001


class AveragePrecision(Evaluator):
    """Average precision for the cross-validator: its built-in area is a trapezoid."""

    def __init__(self, label: str = TASK_LABEL, probability: str = "probability"):
        super().__init__()
        self.label, self.probability = label, probability

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(
            F.col(self.label).cast("int").alias("y"), vector_to_array(self.probability)[1].alias("p")
        )
        value = evaluate(scored, "y", "p", 0.5).first()["pr_auc"]
        return value if value is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


def score(model: PipelineModel, df: DataFrame, output: str = "score") -> DataFrame:
    """Append the positive-class probability; partitions are scored where they lie."""
    scored = model.transform(df)
    return scored.withColumn(output, vector_to_array("probability")[1]).select(*df.columns, output)


def fit_logistic(train: DataFrame, features: Sequence[str] = TASK_FEATURES, label: str = TASK_LABEL,
                 max_iter: int = 1000) -> PipelineModel:
    """Class-balanced logistic regression on standardised features.

    An L2 penalty of 1 on the summed loss is 1 / sum(weights) on MLlib's mean
    loss, and balanced weights sum to the row count.
    """
    weighted = balanced_weights(train, label)
    n = train.count()
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(labelCol=label, weightCol="weight", maxIter=max_iter,
                           regParam=1.0 / max(n, 1), standardization=False),
    ]).fit(weighted)


def coefficients(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, value) of a fitted linear or tree model, one row per model feature."""
    fitted = model.stages[-1]
    values = fitted.coefficients if hasattr(fitted, "coefficients") else fitted.featureImportances
    rows = [(f, float(v)) for f, v in zip(features, values.toArray())]
    return spark.createDataFrame(rows, "feature string, value double").orderBy(
        F.desc(F.abs("value")), "feature"
    )


def logistic_slopes(model: PipelineModel, train: DataFrame, label: str = TASK_LABEL) -> DataFrame:
    """(feature, slope): the derivative of ``fit_logistic``'s penalised loss by each coefficient. It is 0 at the
    optimum."""
    assembler, scaler, fitted = model.stages
    z = vector_to_array(scaler.getOutputCol())
    rows = balanced_weights(train, label)
    rows = scaler.transform(assembler.transform(rows)).withColumn("z", z)
    weights = [float(c) for c in fitted.coefficients]
    total = F.lit(float(fitted.intercept))
    for i, c in enumerate(weights):
        total = total + F.lit(c) * F.col("z")[i]
    rows = rows.withColumn("pull", F.col("weight") * (1.0 / (1.0 + F.exp(-total)) - F.col(label)))
    sums = rows.agg(F.sum("weight").alias("w"), *[F.sum(F.col("pull") * F.col("z")[i]).alias(f"s{i}") for i in range(len(weights))])
    penalty = fitted.getRegParam()
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"), (F.col(f"s{i}") / F.col("w") + F.lit(penalty * c)).alias("slope"))
        for i, (name, c) in enumerate(zip(assembler.getInputCols(), weights))
    ])))


def dealt_evenly(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df``, which has ``rows`` rows, stored in files of equal length, one for each core.

    A fit passes over its rows hundreds of times, and a pass ends with its longest task: files as the
    steps before left them are uneven, and some cores get two of them or none.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return staged(df.repartition(max(1, min(cores, math.ceil(rows / TASK_ROWS)))), name)


def _trees(params: TreeParams, label: str, validation: str | None) -> GBTClassifier:
    trees = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=params.trees, maxDepth=params.depth,
        stepSize=params.rate, subsamplingRate=params.row_share,
        featureSubsetStrategy=str(params.feature_share), validationTol=params.patience, seed=SEED,
    )
    return trees.setValidationIndicatorCol(validation) if validation else trees


def _tree_pipeline(params: TreeParams, features: Sequence[str], label: str, validation: str | None) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        _trees(params, label, validation),
    ])


def fit_trees(train: DataFrame, keys: Sequence[str], params: TreeParams = TreeParams(),
              features: Sequence[str] = TASK_FEATURES, label: str = TASK_LABEL,
              early_stop: bool = True) -> PipelineModel:
    """Boosted trees; with ``early_stop`` a stratified tenth decides when to stop."""
    if not early_stop:
        return _tree_pipeline(params, features, label, None).fit(train)
    held = staged(stratified_holdout(train, label, keys, 0.1, SEED), "holdout")
    return _tree_pipeline(params, features, label, "is_validation").fit(held)


def draw_params(n: int, seed: int = SEED) -> list[TreeParams]:
    """The ranges of random settings. Trees 100-599, depth 3-9, rate 0.01-0.30, both shares 0.6-1.0."""
    rng = random.Random(seed)
    return [
        TreeParams(
            trees=rng.randrange(100, 600), depth=rng.randrange(3, 10),
            rate=round(rng.uniform(0.01, 0.30), 4),
            row_share=round(rng.uniform(0.6, 1.0), 4), feature_share=round(rng.uniform(0.6, 1.0), 4),
        )
        for _ in range(n)
    ]


def tune_trees(train: DataFrame, keys: Sequence[str], draws: Sequence[TreeParams], n_folds: int = 3,
               features: Sequence[str] = TASK_FEATURES, label: str = TASK_LABEL,
               parallelism: int | None = None) -> tuple[DataFrame, TreeParams]:
    """(trials, best): cross-validated average precision of every draw, best first.

    A fit is many short jobs, one after another: by default a fold's draws are fitted side by side, as many as there
    are cores. What a draw finds does not depend on it.
    """
    if parallelism is None:
        parallelism = max(2, min(len(draws), train.sparkSession.sparkContext.defaultParallelism))
    held = stratified_holdout(train, label, keys, 0.1, SEED)  # may end the boosting of a fold early
    folded = staged(stratified_folds(held, label, keys, n_folds, SEED + 1), "folds")
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(folded)
    base = _trees(TreeParams(), label, "is_validation")
    grid = [
        {base.maxIter: p.trees, base.maxDepth: p.depth, base.stepSize: p.rate,
         base.subsamplingRate: p.row_share, base.featureSubsetStrategy: str(p.feature_share)}
        for p in draws
    ]
    search = CrossValidator(
        estimator=base, estimatorParamMaps=grid, evaluator=AveragePrecision(label),
        numFolds=n_folds, foldCol="fold", parallelism=parallelism, seed=SEED,
    ).fit(assembled)
    rows = [
        (i + 1, p.trees, p.depth, p.rate, p.row_share, p.feature_share, float(mean), float(std))
        for i, (p, mean, std) in enumerate(zip(draws, search.avgMetrics, search.stdMetrics))
    ]
    trials = train.sparkSession.createDataFrame(
        rows, "trial int, trees int, depth int, rate double, row_share double, feature_share double, "
              "mean_pr_auc double, std_pr_auc double"
    ).orderBy(F.desc("mean_pr_auc"), "trial")
    return trials, draws[max(range(len(rows)), key=lambda i: rows[i][6])]


def refit_tuned(train: DataFrame, keys: Sequence[str], best: TreeParams, min_trees: int = 500, **kw) -> PipelineModel:
    """Final fit of the best draw, with room for early stopping."""
    roomy = TreeParams(**{**asdict(best), "trees": max(best.trees, min_trees)})
    return fit_trees(train, keys, roomy, **kw)


def fit_sequence_net(train: DataFrame, length: int, n_features: int = len(TASK_FEATURES),
                     label: str = TASK_LABEL, hidden: int = 64, max_iter: int = 50, keys: Sequence[str] = ENTITY,
                     held_share: float = 0.1, step: int = 5, patience: int = 2) -> PipelineModel:
    """A one-hidden-layer net over the flattened lookback sequence, stopped early.

    A share of the entities is held out. The net is fitted ``step`` iterations at a time, each
    time from the last weights; when the loss on held-out rows has not fallen ``patience`` times
    in a row, the best weights are the model. Without held-out rows all iterations run.
    """
    dealt = random_holdout(flat_vector(train, output="raw"), keys, held_share, SEED, "__held")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(dealt.where("NOT __held"))
    ready = dealt_evenly(scaler.transform(dealt).select(label, "features", "__held"), train.count(), "scaled")
    fit_side, held = ready.where("NOT __held"), ready.where("__held")
    weights, best, least, worse = None, None, float("inf"), 0
    for _ in range(0, max_iter, step):
        net = MultilayerPerceptronClassifier(labelCol=label, layers=[length * n_features, hidden, 2], maxIter=step, seed=SEED, blockSize=NET_BLOCK)
        model = (net.setInitialWeights(weights) if weights is not None else net).fit(fit_side)
        weights = model.weights
        loss = log_loss(model.transform(held), label)
        if loss is None or loss < least:
            best, least, worse = model, loss if loss is not None else least, 0
            continue
        worse += 1
        if worse == patience:
            break
    return PipelineModel([scaler, best])


def log_loss(scored: DataFrame, label: str) -> float | None:
    """Mean negative log of the probability of each row's own class, None without rows."""
    own = F.element_at(vector_to_array("probability"), F.col(label).cast("int") + 1)
    return scored.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15))))).first()[0]


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str,
                           keys: Sequence[str], seed: int = SEED) -> DataFrame:
    """(feature, importance): how far average precision falls when a feature comes from another row.

    The other row is the next one in hash order, so every value is used once. All copies of a row, one
    for each feature, are scored in the same pass.
    """
    rows = staged(rank_by_hash(df.select(*keys, label, *features), keys, seed, rank="__rank", size="__n"), "ranked")
    other = rows.select((F.col("__rank") % F.col("__n") + 1).alias("__rank"), *[F.col(c).alias(f"__other_{c}") for c in features])
    changed = [F.struct(F.lit(name).alias("feature"), *[F.col(f"__other_{c}" if c == name else c).alias(c) for c in features])
               for name in (*features, "")]
    copies = rows.join(other, "__rank").select(label, F.inline(F.array(*changed)))
    precision = evaluate(score(model, copies), label, "score", 0.5, by=["feature"]).select("feature", "pr_auc")
    whole = precision.where("feature = ''").agg(F.max("pr_auc")).scalar()
    return precision.where("feature <> ''").select("feature", (whole - F.col("pr_auc")).alias("importance"))


def tuned_report(train_scored: DataFrame, test_scored: DataFrame, name: str, label: str = TASK_LABEL,
                 score_col: str = "score", grid=PROBABILITY_GRID, strict: bool = False) -> DataFrame:
    """One registry row: threshold chosen on train, all metrics on test."""
    best = best_threshold(threshold_sweep(train_scored, label, score_col, grid, strict))
    threshold = best.select("threshold").first()["threshold"]
    return evaluate(test_scored, label, score_col, threshold, strict=strict).select(
        F.lit(name).alias("model"), "*", F.lit(threshold).alias("threshold")
    )


def ablation(train: DataFrame, test: DataFrame, keys: Sequence[str], params: TreeParams = TreeParams(trees=200, rate=0.1),
             groups: Mapping[str, Sequence[str]] = FEATURE_GROUPS, features: Sequence[str] = TASK_FEATURES,
             label: str = TASK_LABEL) -> DataFrame:
    """Metrics of the same model on each feature group and on all features. A stratified tenth of the train side
    may end the boosting early."""
    check_feature_groups(groups, features)
    table = None
    for group, columns in {**groups, "all features": tuple(features)}.items():
        model = fit_trees(train, keys, params, columns, label)
        row = evaluate(score(model, test), label, "score", 0.5).select(
            F.lit(group).alias("feature_group"), F.lit(len(columns)).alias("n_features"), "*"
        )
        table = row if table is None else table.unionByName(row)
    return table


def best_solo_group(table: DataFrame) -> DataFrame:
    """The strongest single group and its share of the full model's ROC-AUC."""
    full = table.where(F.col("feature_group") == "all features").agg(F.max("roc_auc")).scalar()
    solo = table.where(F.col("feature_group") != "all features").orderBy(
        F.desc("roc_auc"), "feature_group"
    ).limit(1)
    return solo.select("feature_group", "roc_auc", (100.0 * F.col("roc_auc") / full).alias("pct_of_full"))

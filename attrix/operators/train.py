"""Model building and tuning on MLlib (survey 2.5 ENC-9/11, 2.10, DRF-4, CMP-3).

Fits are MLlib estimators (distributed); the driver only loops over trials
and folds and submits Spark jobs (optionally from a thread pool, like the
reference's ``n_jobs``).  Randomised choices are seeded so runs repeat.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.operators import evaluate as ev
from attrix.operators.extra_trees import ExtraTreesClassifier
from attrix.operators.kernels import hash_order
from attrix.operators.stages import feature_lineage, feature_stages, transform_only  # noqa: F401  (ENC-9)
from attrix.operators.windows import train_test_split
from attrix.session import materialize

# Fixed values from the reference's training configuration.
TEST_SET_PERCENTAGE = 0.20
CV_FOLDS = 5
TRIALS = 15
SEED = 19
FOREST_SPACE = {
    "maxDepth": ("int", 3, 16),
    "minWeightFractionPerNode": ("float", 0.001, 0.01),
    "featureSubsetStrategy": ("choice", ["log2", "sqrt"]),
}
BOOSTING_SPACE = {
    "stepSize": ("float", 0.01, 0.5),
    "maxIter": ("int", 75, 149),
    "maxDepth": ("int", 3, 15),
    "minInstancesPerNode": ("int", 2, 16),
}
CONCEPT_GRID = {"maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 3], "featureSubsetStrategy": ["log2", "sqrt"]}
CONCEPT_THRESHOLD = 0.55
#: Poisson(1) exceeds this with probability 1e-18, less than a hash can tell.
POISSON_TERMS = 20


# ---------------------------------------------------------------- TRN-1
def training_frame(df: DataFrame, key: str, target: str, drop: Sequence[str] = (), positive: str = "yes") -> DataFrame:
    """TRN-1: drop id columns, encode the target 1/0, deterministic 80/20 split column."""
    out = df.drop(*[c for c in drop if c != key]).withColumn("label", F.when(F.col(target) == positive, 1).otherwise(0))
    return train_test_split(out.drop(target), key, TEST_SET_PERCENTAGE)


# ---------------------------------------------------------------- ENC-11
def build_pipeline(model, **spec) -> Pipeline:
    """ENC-11: feature stages followed by the classifier (reads 'features'/'label')."""
    return Pipeline(stages=[*feature_stages(**spec), model])


# ---------------------------------------------------------------- TRN-4/5/6
def model_family(name: str, params: Mapping | None = None):
    """TRN-4 random forest, TRN-5 extra trees, TRN-6 gradient boosting."""
    params = dict(params or {})
    if name == "random_forest":
        return RandomForestClassifier(seed=SEED, **params)
    if name == "extra_trees":
        return ExtraTreesClassifier(seed=SEED, **params)
    if name == "gradient_boosting":
        return GBTClassifier(seed=SEED, **params)
    raise ValueError(f"unknown model family {name!r}")


#: The pipeline's own parameters, tuned with the model's.
PIPELINE_SPACE = {
    "take_log": ("choice", ["yes", "no"]),
    "combine": ("choice", ["yes", "no"]),
    "cat_percentile": ("int", 1, 100),
    "num_percentile": ("int", 1, 100),
}


def pipeline_maker(spec: Mapping, family) -> Callable[[dict], Pipeline]:
    """TRN-2, UDF-4: parameters of a trial -> pipeline.  Those of PIPELINE_SPACE
    change the feature stages, the others are the model's; ``family`` is a
    built-in name, an Estimator that gets them by name, or a function of them."""

    def make(params: dict) -> Pipeline:
        own = {k: v for k, v in params.items() if k not in PIPELINE_SPACE}
        if isinstance(family, str):
            model = model_family(family, own)
        elif isinstance(family, Estimator):
            model = family.copy({family.getParam(k): v for k, v in own.items()})
        else:
            model = family(own)
        changed = {k: v for k, v in params.items() if k in PIPELINE_SPACE and k != "take_log"}
        if params.get("take_log") == "no":
            changed["log_cols"] = ()
        return build_pipeline(model, **{**spec, **changed})

    return make


def draw_params(space: Mapping, trials: int = TRIALS, seed: int = SEED) -> list[dict]:
    """Seeded random search over the space (re-aims the TPE optimiser)."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        p = {}
        for k, spec in space.items():
            if spec[0] == "int":
                p[k] = rng.randint(spec[1], spec[2])
            elif spec[0] == "float":
                p[k] = rng.uniform(spec[1], spec[2])
            else:
                p[k] = rng.choice(spec[1])
        out.append(p)
    return out


def _prob(df: DataFrame) -> DataFrame:
    return df.withColumn("prob", vector_to_array("probability")[1])


def cv_fold_scores(
    train: DataFrame,
    key: str,
    make_pipeline: Callable[[dict], Pipeline],
    trials: Sequence[dict],
    folds: int = CV_FOLDS,
    parallelism: int = 2,
) -> DataFrame:
    """TRN-2/3: neg log loss of every (trial, fold): fit on the other folds,
    score the held-out fold.  Folds come from the md5 order of the key."""
    data = train.withColumn("_fold", (hash_order(F.col(key)) % folds).cast("int"))
    spark = train.sparkSession

    def one(args):
        t, f = args
        m = make_pipeline(trials[t]).fit(data.where(F.col("_fold") != f))
        s = _prob(m.transform(data.where(F.col("_fold") == f)))
        ll = s.agg(ev.log_loss_expr("label", "prob").alias("ll")).first()["ll"]
        return (t, f, -float(ll))

    jobs = [(t, f) for t in range(len(trials)) for f in range(folds)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows = list(pool.map(one, jobs))
    return spark.createDataFrame(rows, "trial int, fold int, score double")


def tune(
    train: DataFrame,
    key: str,
    make_pipeline: Callable[[dict], Pipeline],
    space: Mapping,
    trials: int = TRIALS,
    folds: int = CV_FOLDS,
    parallelism: int = 2,
):
    """TRN-2: random search with k-fold CV on neg log loss, refit of the best
    trial on all training rows.  Returns (fitted model, leaderboard)."""
    from attrix.operators.leaderboard import cv_leaderboard

    params = draw_params(space, trials)
    scores = cv_fold_scores(train, key, make_pipeline, params, folds, parallelism)
    board = cv_leaderboard(scores, ["trial"], n_folds=folds)
    best = board.where(F.col("ranking") == 0).first()["trial"]
    return make_pipeline(params[best]).fit(train), board, params


# ---------------------------------------------------------------- TRN-7 / TRN-8
class Calibrated:
    """A fitted model plus a probability calibrator (Platt or isotonic)."""

    def __init__(self, model, calibrator, method: str):
        self.model, self.calibrator, self.method = model, calibrator, method

    def transform(self, df: DataFrame) -> DataFrame:
        s = _prob(self.model.transform(df)).drop("features", "rawPrediction", "probability", "prediction")
        if self.method == "sigmoid":
            s = VectorAssembler(inputCols=["prob"], outputCol="_cal_x").transform(s)
            out = self.calibrator.transform(s)
            return out.withColumn("prob", vector_to_array("probability")[1]).drop(
                "_cal_x", "rawPrediction", "probability", "prediction"
            )
        out = self.calibrator.setFeaturesCol("prob").setPredictionCol("_iso").transform(s)
        return out.withColumn("prob", F.col("_iso")).drop("_iso")


def calibrate_fitted(model, validation: DataFrame, method: str = "sigmoid") -> Calibrated:
    """TRN-8: prefit calibration on a validation frame (sigmoid = Platt
    logistic regression on the score; isotonic = MLlib IsotonicRegression)."""
    s = _prob(model.transform(validation)).select("prob", "label")
    if method == "sigmoid":
        va = VectorAssembler(inputCols=["prob"], outputCol="_cal_x").transform(s)
        cal = LogisticRegression(featuresCol="_cal_x", labelCol="label").fit(va)
    elif method == "isotonic":
        cal = IsotonicRegression(featuresCol="prob", labelCol="label").fit(s.withColumn("label", F.col("label").cast("double")))
    else:
        raise ValueError("method must be 'sigmoid' or 'isotonic'")
    return Calibrated(model, cal, method)


class FoldAverage:
    """Calibrated models of the folds; ``prob`` is the mean of theirs."""

    def __init__(self, members: Sequence[Calibrated]):
        self.members = list(members)

    def transform(self, df: DataFrame) -> DataFrame:
        out, probs = df, []
        for i, m in enumerate(self.members):
            kept = [*df.columns, *probs]
            probs.append(f"_prob_{i}")
            out = m.transform(out).select(*kept, F.col("prob").alias(probs[-1]))
        mean = sum((F.col(p) for p in probs), F.lit(0.0)) / len(probs)
        return out.withColumn("prob", mean).drop(*probs)


def calibrated_cv(train: DataFrame, key: str, pipeline: Pipeline, folds: int = 3) -> FoldAverage:
    """TRN-7: k-fold sigmoid calibration: each fold's rows calibrate the model
    fitted on the other folds; the scorer averages the folds."""
    data = train.withColumn("_fold", (hash_order(F.col(key)) % folds).cast("int"))
    members = []
    for f in range(folds):
        m = pipeline.fit(data.where(F.col("_fold") != f).drop("_fold"))
        members.append(calibrate_fitted(m, data.where(F.col("_fold") == f).drop("_fold")))
    return FoldAverage(members)


# ---------------------------------------------------------------- DRF-4
def concept_shift_report(
    train: DataFrame,
    prod: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    key: str,
    model_uid: str,
    threshold: float = CONCEPT_THRESHOLD,
    folds: int = 3,
    grid: Mapping | None = None,
    parallelism: int = 2,
) -> DataFrame:
    """DRF-4: can a forest tell production rows (1) from training rows (0)?
    Grid search over the reference's 12-point grid with k-fold ROC AUC on the
    training split, refit of the best point; an AUC >= threshold on the test
    split means the concept has shifted.  One result row."""
    cols = [key, *numeric, *categorical]
    data = train.select(*cols).withColumn("label", F.lit(0)).unionByName(prod.select(*cols).withColumn("label", F.lit(1)))
    data = train_test_split(data, key, TEST_SET_PERCENTAGE).withColumn("_fold", (hash_order(F.col(key)) % folds).cast("int"))
    data = materialize(data, "concept-shift")  # read by every fit
    held_out, data = data.where("split = 'test'"), data.where("split = 'train'")
    cf = [f"{c}__f" for c in categorical]
    fill = SQLTransformer(
        statement="SELECT *, " + ", ".join(f"coalesce(CAST(`{c}` AS STRING), 'unknown') AS `{c}__f`" for c in categorical)
        + " FROM __THIS__"
    ) if categorical else SQLTransformer(statement="SELECT * FROM __THIS__")
    stages = [fill]
    vec_in = []
    if categorical:
        stages += [
            StringIndexer(inputCols=cf, outputCols=[f"{c}__i" for c in cf], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}__i" for c in cf], outputCols=[f"{c}__v" for c in cf], dropLast=True,
                          handleInvalid="keep"),
        ]
        vec_in += [f"{c}__v" for c in cf]
    if numeric:
        stages.append(Imputer(inputCols=list(numeric), outputCols=[f"{c}__m" for c in numeric], strategy="mean"))
        vec_in += [f"{c}__m" for c in numeric]
    stages.append(VectorAssembler(inputCols=vec_in, outputCol="features", handleInvalid="keep"))
    grid = grid or CONCEPT_GRID
    points = [
        RandomForestClassifier(maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=feat, seed=SEED)
        for depth in grid["maxDepth"]
        for leaf in grid["minInstancesPerNode"]
        for feat in grid["featureSubsetStrategy"]
    ]

    def fold_auc(job):
        rf, f = job
        m = Pipeline(stages=[*stages, rf]).fit(data.where(F.col("_fold") != f))
        s = _prob(m.transform(data.where(F.col("_fold") == f)))
        return ev.roc_auc(s, "label", "prob").first()["roc_auc"]

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        aucs = list(pool.map(fold_auc, [(rf, f) for rf in points for f in range(folds)]))
    means = [sum(aucs[i : i + folds]) / folds for i in range(0, len(aucs), folds)]
    best_rf = points[means.index(max(means))]
    model = Pipeline(stages=[*stages, best_rf]).fit(data)
    auc = ev.roc_auc(_prob(model.transform(held_out)), "label", "prob").first()["roc_auc"]
    spark = train.sparkSession
    return spark.createDataFrame(
        [(auc >= threshold, "roc_auc", float(threshold), float(auc), model_uid)],
        "shift_occurred boolean, metric_used string, scoring_threshold double, model_score double, model_uid string",
    )


# ---------------------------------------------------------------- CMP-3 (refits)
def poisson_weight(key: str, round_) -> Column:
    """How often a bootstrap round draws a row: Poisson(1), inverted at a hash of (key, round)."""
    u = (hash_order(F.col(key), F.lit(round_) if isinstance(round_, int) else round_).cast("double") + 0.5) / F.lit(float(1 << 60))
    term, below, out = math.exp(-1.0), 0.0, F.lit(0)
    for k in range(1, POISSON_TERMS):
        below += term
        out = out + F.when(u > below, 1).otherwise(0)
        term /= k
    return out.cast("double")


def bootstrap_predictions(
    train: DataFrame, test: DataFrame, key: str, pipeline: Pipeline, rounds: int = 20, cutoff: float = 0.5
) -> DataFrame:
    """CMP-3: refit on ``rounds`` bootstrap resamples and predict the test rows:
    (key, label, round, pred) for ``bias_variance``.

    A resample is a Poisson(1) weight of each row by a hash of its key and the
    round, which the last stage takes as its weight column; so a round doesn't
    depend on how the rows lie, and a lost executor doesn't change it."""
    *features, model = pipeline.getStages()
    if not model.hasParam("weightCol"):
        raise TypeError(f"{type(model).__name__} takes no weights")
    weighted = Pipeline(stages=[*features, model.copy({model.getParam("weightCol"): "_weight"})])
    out = None
    for r in range(rounds):
        m = weighted.fit(train.withColumn("_weight", poisson_weight(key, r)).where("_weight > 0"))
        p = _prob(m.transform(test)).select(
            key, "label", F.lit(r).alias("round"), F.when(F.col("prob") >= cutoff, 1).otherwise(0).alias("pred")
        )
        out = p if out is None else out.unionByName(p)
    return out


MODEL_FAMILIES = [("random_forest", FOREST_SPACE), ("extra_trees", FOREST_SPACE), ("gradient_boosting", BOOSTING_SPACE)]


def train_all(
    df: DataFrame,
    key: str,
    target: str,
    spec: Mapping,
    families=MODEL_FAMILIES,
    trials: int = TRIALS,
    folds: int = CV_FOLDS,
    parallelism: int = 2,
) -> dict[str, dict]:
    """For each model family: split, tune, refit, evaluate on the test split, in
    memory.  Returns {family: {model, leaderboard, params, evaluation}};
    ``runs.train_run`` is the run with its folders (TRN-9)."""
    frame = materialize(training_frame(df, key, target), "training")
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    out = {}
    for name, space, *maker in families:
        make = pipeline_maker(spec, maker[0] if maker else name)
        model, board, params = tune(train, key, make, {**PIPELINE_SPACE, **space}, trials, folds, parallelism)
        preds = _prob(model.transform(test)).select(key, "label", "prob")
        out[name] = {
            "model": model,
            "leaderboard": board,
            "params": params,
            "evaluation": ev.evaluate_all(preds, name),
        }
    return out

"""Training runs: a folder a model, committed by a manifest (survey TRN-9, TRN-7).

A run of a model family has a folder ``<run_dir>/<uid>`` with its parts: the
rows it was trained and tested on, the search, the fitted model, predictions,
score rows and explanation rows.  Each part that is whole leaves a line in
``log`` (rows and seconds), and the manifest, written last, has all of them.
So a folder without a manifest is a run that died: ``run_states`` shows how far
it came, and the next ``train_run`` into the same place goes on with it; parts
that are there are read, not made again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.operators import evaluate as ev
from attrix.operators import train as tr
from attrix.operators.explain import global_importance, has_trees
from attrix.operators.leaderboard import cv_leaderboard
from attrix.operators.trees import fold_shapley, model_shapley

PARTS = ("data", "leaderboard", "model", "predictions", "model_score", "feature_score")
LOG = "uid string, family string, part string, rows long, seconds double"


class CalibratedModel(Model, MLReadable, MLWritable):
    """TRN-7 as a stage that is saved: the calibrated models of the folds, whose
    mean probability is ``prob``, also as ``probability`` for other operators."""

    def __init__(self, members: Sequence[tr.Calibrated] = ()):
        super().__init__()
        self.members = list(members)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        out = tr.FoldAverage(self.members).transform(dataset)
        return out.withColumn("probability", array_to_vector(F.array(1.0 - F.col("prob"), F.col("prob"))))

    def write(self) -> MLWriter:
        return _CalibratedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CalibratedReader()


class _CalibratedWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        methods = [m.method for m in self.instance.members]
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"methods": methods})
        for i, m in enumerate(self.instance.members):
            m.model.write().save(f"{path}/members/{i}/model")
            m.calibrator.write().save(f"{path}/members/{i}/calibrator")


class _CalibratedReader(MLReader):
    def load(self, path: str) -> CalibratedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        kinds = {"sigmoid": LogisticRegressionModel, "isotonic": IsotonicRegressionModel}
        members = [
            tr.Calibrated(PipelineModel.load(f"{path}/members/{i}/model"), kinds[m].load(f"{path}/members/{i}/calibrator"), m)
            for i, m in enumerate(metadata["methods"])
        ]
        model = CalibratedModel(members)
        model._resetUid(metadata["uid"])
        return model


# ---------------------------------------------------------------- run folders
def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _folders(spark: SparkSession, path: str) -> list[str]:
    if not _exists(spark, path):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


class RunFolder:
    """Parts of one run, each made once."""

    def __init__(self, spark: SparkSession, run_dir: str, uid: str, family: str):
        self.spark, self.uid, self.family, self.path = spark, uid, family, f"{run_dir.rstrip('/')}/{uid}"

    @classmethod
    def open(cls, spark: SparkSession, run_dir: str, family: str) -> RunFolder:
        """The family's run without a manifest, if there is one; else a new one."""
        for r in run_states(spark, run_dir).where((F.col("family") == family) & ~F.col("complete")).orderBy("uid").collect():
            return cls(spark, run_dir, r["uid"], family)
        uid = f"{family}_{datetime.now(UTC).strftime('%Y%m%d%H%M%S%f')}"
        run = cls(spark, run_dir, uid, family)
        run._log("started", 0, 0.0)
        return run

    def _log(self, part: str, rows: int, seconds: float) -> None:
        line = self.spark.createDataFrame([(self.uid, self.family, part, rows, seconds)], LOG)
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/part={part}")

    def done(self, part: str) -> bool:
        return _exists(self.spark, f"{self.path}/log/part={part}/_SUCCESS")

    def table(self, part: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The part's table, made and written if it isn't whole."""
        place = f"{self.path}/{part}"
        if not self.done(part):
            began = time.time()
            make().write.mode("overwrite").parquet(place)
            self._log(part, self.spark.read.parquet(place).count(), time.time() - began)
        return self.spark.read.parquet(place)

    def model(self, part: str, make: Callable[[], Model], load: Callable[[str], Model]) -> Model:
        place = f"{self.path}/{part}"
        if not self.done(part):
            began = time.time()
            make().write().overwrite().save(place)
            self._log(part, 0, time.time() - began)
        return load(place)

    def commit(self) -> None:
        log = self.spark.read.schema(LOG).parquet(*[f"{self.path}/log/part={p}" for p in ("started", *PARTS)])
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")


def run_states(spark: SparkSession, run_dir: str) -> DataFrame:
    """(uid, family, complete, parts, seconds) of each run: what is whole, and whether all is."""
    rows = []
    for uid in _folders(spark, run_dir):
        parts = [p.removeprefix("part=") for p in _folders(spark, f"{run_dir}/{uid}/log")]
        whole = [p for p in parts if _exists(spark, f"{run_dir}/{uid}/log/part={p}/_SUCCESS")]
        if "started" not in whole:
            continue  # not a run
        log = spark.read.schema(LOG).parquet(*[f"{run_dir}/{uid}/log/part={p}" for p in whole]).collect()
        rows.append((uid, log[0]["family"], _exists(spark, f"{run_dir}/{uid}/manifest/_SUCCESS"), sorted(p for p in whole if p != "started"), float(sum(r["seconds"] for r in log))))
    return spark.createDataFrame(rows, "uid string, family string, complete boolean, parts array<string>, seconds double")


# ---------------------------------------------------------------- the run
def search(train: DataFrame, key: str, make: Callable[[dict], Pipeline], space: Mapping, trials: int, folds: int, parallelism: int) -> DataFrame:
    """TRN-2/3: the leaderboard of a seeded random search, with each trial's parameters as JSON."""
    params = tr.draw_params(space, trials)
    board = cv_leaderboard(tr.cv_fold_scores(train, key, make, params, folds, parallelism), ["trial"], n_folds=folds)
    texts = train.sparkSession.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(params)], "trial int, params string")
    return board.join(texts, "trial")


def train_run(
    df: DataFrame,
    key: str,
    target: str,
    spec: Mapping,
    run_dir: str,
    families: Sequence[tuple] = tr.MODEL_FAMILIES,
    trials: int = tr.TRIALS,
    folds: int = tr.CV_FOLDS,
    calibration_folds: int = 3,
    parallelism: int = 2,
) -> dict[str, str]:
    """TRN-9: for each family (name, space[, maker]): snapshot, search with the
    pipeline's own parameters in the space, refit of the best trial with
    calibration by folds, predictions of the test split, score rows and
    explanation rows.  Returns {family: uid}; everything else is in the folders.

    ``maker`` (UDF-4) is an Estimator that takes the space's parameters, or a
    function of them that gives one; without it the name is a built-in family.
    ``calibration_folds`` of 0 fits the pipeline alone."""
    spark = df.sparkSession
    out = {}
    for name, space, *maker in families:
        run = RunFolder.open(spark, run_dir, name)
        make = tr.pipeline_maker(spec, maker[0] if maker else name)
        data = run.table("data", lambda: tr.training_frame(df, key, target))
        train, test = data.where("split = 'train'"), data.where("split = 'test'")
        board = run.table("leaderboard", lambda: search(train, key, make, {**tr.PIPELINE_SPACE, **space}, trials, folds, parallelism))
        best = make(json.loads(board.orderBy("ranking").first()["params"]))
        if calibration_folds:
            model = run.model("model", lambda: CalibratedModel(tr.calibrated_cv(train, key, best, calibration_folds).members), CalibratedModel.load)
            base = [m.model for m in model.members]
        else:
            model = run.model("model", lambda: best.fit(train), PipelineModel.load)
            base = [model]
        preds = run.table("predictions", lambda: ev.predictions_frame(tr._prob(model.transform(test)).select(key, "label", "prob")))
        run.table("model_score", lambda: ev.metric_table(preds, run.uid))
        run.table("feature_score", lambda: feature_scores(test, key, base, run.uid))
        run.commit()
        out[name] = run.uid
    return out


def feature_scores(rows: DataFrame, key: str, models: Sequence[PipelineModel], uid: str) -> DataFrame:
    """Explanation rows of a run: mean absolute Shapley value by feature for trees
    (mean of the folds), else the fitted model's own scores."""
    if has_trees(models[0].stages[-1]):
        shap = model_shapley(rows, key, models[0]) if len(models) == 1 else fold_shapley(rows, key, models)
        return global_importance(shap, uid)
    from attrix.operators.explain import embedded_scores

    names = [[r["feature"] for r in tr.feature_lineage(m).orderBy("slot").collect()] for m in models]
    scores = [s for m, n in zip(models, names) for s in embedded_scores(m.stages[-1], n)]
    table = rows.sparkSession.createDataFrame(scores, "feature string, importance_score double")
    return table.groupBy("feature").agg((F.sum("importance_score") / float(len(models))).alias("importance_score")).select(
        F.lit(uid).alias("model_uid"), "feature", "importance_score", F.lit("embedded").alias("importance_metric")
    )

"""The Spark ML pipeline: feature preparation, classifier, evaluation."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    RegexTokenizer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.functions.text import bucket_of
from prsignal.operators.features import prepare_training_data
from prsignal.operators.label import labelled_lines
from prsignal.operators.sample import split_by_key, summarize, weigh_classes
from prsignal.operators.words import fit_word_vectors
from prsignal.session import materialize
from prsignal.sources.sinks import fingerprint

# Parameters of the model.
MAX_BINS = 50
MIN_INFO_GAIN_GRID = (0.0, 0.0001)
FOLDS = 3
PARALLELISM = 2
MIN_DOC_FREQ = 10
# Columns that words are hashed to.
HASHES = 1 << 12
SEED = 42
# Columns of prepared rows that no step of the model looks at.
CONTEXT = ("previous_lines", "next_lines")


def tokenizer() -> RegexTokenizer:
    """Lower-cased words of a line."""
    return RegexTokenizer(inputCol="line_text", outputCol="tokens")


def indexer() -> StringIndexer:
    """Number of a line's extension, most frequent first, ties by name; lines without one are left out."""
    return StringIndexer(inputCol="extension", outputCol="extension_index", handleInvalid="skip")


def term_frequencies(n_hashes: int = HASHES, min_doc_freq: int = MIN_DOC_FREQ) -> list:
    """Words hashed to ``n_hashes`` columns, and their weights by inverse document frequency."""
    return [
        HashingTF(inputCol="tokens", outputCol="raw_tf", numFeatures=n_hashes),
        IDF(inputCol="raw_tf", outputCol="tf_idf", minDocFreq=min_doc_freq),
    ]


def sample_of_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows at most, chosen by hash of ``key``, so that reruns agree."""
    part = min(n / max(df.count(), 1), 1.0)
    return df if part == 1.0 else df.where(bucket_of(F.col(key), 1_000_000) < round(part * 1_000_000))


def fit_prep(
    df: DataFrame,
    word_vectors: bool = False,
    n_hashes: int = HASHES,
    min_doc_freq: int = MIN_DOC_FREQ,
    vector_size: int = 100,
    min_count: int = 5,
) -> PipelineModel:
    """The fitted steps from prepared rows to features: extension index, tokens, text vector, assembled.

    Text becomes hashed term frequencies, whose fitting needs sums of fixed size
    only.  ``word_vectors`` uses the mean of word vectors instead; these are
    fitted on all rows, and their vocabulary is a table.
    """
    words = tokenizer()
    with_words = words.transform(df)
    if word_vectors:
        text = [fit_word_vectors(with_words, "tokens", "wordvecs", vector_size, min_count, SEED)]
        column = "wordvecs"
    else:
        hashed, weights = term_frequencies(n_hashes, min_doc_freq)
        text = [hashed, weights.fit(hashed.transform(with_words))]
        column = weights.getOutputCol()
    features = VectorAssembler(
        inputCols=[column, "only_spaces", "extension_index", "line_length", "not_in_issues"], outputCol="features"
    )
    return PipelineModel([indexer().fit(df), words, *text, features])


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def prep_address(df: DataFrame, store: str, **options) -> str:
    """Where the steps fitted on these rows with these options are kept in a store.

    Word vectors of a store may be of a time when they were fitted on a sample; these are not found.
    """
    rows = fingerprint(df.select("extension", "line_text")).first()
    fitted_on = ["all rows"] if options.get("word_vectors") else []
    said = json.dumps([sorted(options.items()), rows.n_rows, rows.content_id, *fitted_on])
    return f"{store}/{hashlib.sha256(said.encode()).hexdigest()[:32]}"


def load_or_fit_prep(df: DataFrame, store: str | None, **options) -> PipelineModel:
    """The steps kept in ``store`` for the same rows and options; fitted and kept where there are none.

    They are written aside and then renamed, so that a reader finds all or
    nothing; of two that fit at once, the first stays.
    """
    if store is None:
        return fit_prep(df, **options)
    spark, path = df.sparkSession, prep_address(df, store, **options)
    if not path_exists(spark, path):
        aside = f"{store}/_aside-{uuid.uuid4().hex}"
        fit_prep(df, **options).write().save(aside)
        source, files = _file_system(spark, aside)
        target, _ = _file_system(spark, path)
        if files.exists(target) or not files.rename(source, target):
            files.delete(source, True)
    return PipelineModel.load(path)


def with_folds(df: DataFrame, folds: int = FOLDS, key: str = "pull_request_url") -> DataFrame:
    """Add ``fold``, from a hash of ``key``: all rows of a pull request are in one fold."""
    return df.withColumn("fold", bucket_of(F.col(key), folds).cast("int"))


def train_classifier(features: DataFrame, fast: bool = False, folds: int = FOLDS, **options) -> CrossValidatorModel:
    """Gradient-boosted trees, chosen by cross validation on area under PR.

    ``features`` has the columns features, label, weight and fold.  Rows count
    by their weight, in trees as in areas; none is repeated, so no row is on
    both sides of a fold.
    """
    classifier = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxBins=MAX_BINS, seed=SEED, **options
    )
    grid = ParamGridBuilder()
    if not fast:
        grid = grid.addGrid(classifier.minInfoGain, list(MIN_INFO_GAIN_GRID))
    return CrossValidator(
        estimator=classifier,
        evaluator=BinaryClassificationEvaluator(labelCol="label", weightCol="weight", metricName="areaUnderPR"),
        estimatorParamMaps=grid.build(),
        numFolds=folds,
        foldCol="fold",
        parallelism=PARALLELISM,
        collectSubModels=False,
        seed=SEED,
    ).fit(features)


@dataclass
class Trained:
    model: PipelineModel
    cross_validation: CrossValidatorModel


def train_model(
    prepared: DataFrame,
    prep_store: str | None = None,
    fast: bool = False,
    prep_options: dict | None = None,
    classifier_options: dict | None = None,
) -> Trained:
    """Weigh, prepare, cross validate; the result scores prepared rows.

    ``prepared`` has the pull request of each row, by which folds are dealt.
    """
    rows = materialize(with_folds(weigh_classes(prepared.drop(*CONTEXT))))
    prep = load_or_fit_prep(rows, prep_store, **(prep_options or {}))
    features = prep.transform(rows).select("features", "label", "weight", "fold").persist()
    try:
        validated = train_classifier(features, fast, **(classifier_options or {}))
    finally:
        features.unpersist()
    return Trained(PipelineModel([prep, validated.bestModel]), validated)


def score(model: Transformer, prepared: DataFrame) -> DataFrame:
    """Prepared rows with ``prediction`` and ``p1``, the probability of a comment."""
    return model.transform(prepared).withColumn("p1", vector_to_array("probability")[1])


def evaluate(scored: DataFrame) -> dict[str, float]:
    """Areas under PR and ROC, from every distinct score."""
    return {
        name: BinaryClassificationEvaluator(labelCol="label", metricName=metric, numBins=0).evaluate(
            scored
        )
        for name, metric in (("pr", "areaUnderPR"), ("roc", "areaUnderROC"))
    }


def cv_summary(validated: CrossValidatorModel) -> list[dict]:
    """Parameters and mean score (on weighted classes) of every cross-validated model."""
    return [
        {"params": {p.name: v for p, v in params.items()}, "area_under_pr": metric}
        for params, metric in zip(validated.getEstimatorParamMaps(), validated.avgMetrics)
    ]


def train_and_evaluate(
    resolved: DataFrame,
    facts: DataFrame,
    prep_store: str | None = None,
    train: float = 0.9,
    fast: bool = False,
    compat: bool = False,
    prep_options: dict | None = None,
    classifier_options: dict | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Train on most pull requests, evaluate on the rest: (model, report of one row).

    Labels and features are computed once for all pull requests and then split
    by pull request, so no line of a pull request is on both sides.
    """
    spark = resolved.sparkSession
    prepared = materialize(
        prepare_training_data(
            labelled_lines(resolved, compat),
            facts,
            compat=compat,
            keep=("pull_request_url",),
        ).drop(*CONTEXT)
    )
    size = summarize(prepared).first()
    train_rows, test_rows = split_by_key(prepared, train=train)
    trained = train_model(train_rows, prep_store, fast, prep_options, classifier_options)
    scored = score(trained.model, test_rows).select("label", "rawPrediction", "p1").persist()
    try:
        metrics = evaluate(scored)
    finally:
        scored.unpersist()
    cv = cv_summary(trained.cross_validation)
    report = spark.createDataFrame(
        [
            (
                float(metrics["pr"]),
                float(metrics["roc"]),
                size.n,
                size.positives,
                [({k: str(v) for k, v in c["params"].items()}, float(c["area_under_pr"])) for c in cv],
            )
        ],
        "pr double, roc double, n bigint, positives bigint, "
        "cv array<struct<params:map<string,string>,area_under_pr:double>>",
    )
    return trained.model, report

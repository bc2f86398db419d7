"""Supervised decision: model probability against a threshold that depends on the row."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.text import contains_any
from keysieve.operators.encode import assemble, encoded
from keysieve.operators.heuristic import Scorer, _flag, _text, decide
from keysieve.operators.linear import LinearModel
from keysieve.sources.publish import publish


def approval_threshold(
    rows: DataFrame,
    base: float = C.APPROVE_THRESHOLD,
    named_dumps: Sequence[str] = C.NAMED_DUMP_PATHS,
    providers: Sequence[str] = tuple(s.provider for s in C.SIGNATURES),
) -> Column:
    """Probability a row must reach: generic types need far more than specific ones."""
    have = rows.columns

    def flag(name: str) -> Column:
        return _flag(name, have)

    provider = _text("provider", have)
    window = F.lower(_text("context_window", have))
    path = F.lower(_text("file_path", have) if "file_path" in have else _text("File", have))
    generic = provider.startswith("Generic") | (provider == C.UUID_PROVIDER)
    specific = provider.isin(*providers) & ~generic
    operational = (provider == C.UUID_PROVIDER) & contains_any(window, C.OPERATIONAL_UUID_TERMS)
    bound = flag("variable_is_sensitive") | flag("has_secret_term_nearby")
    reject = F.lit(C.GENERIC_REJECT_THRESHOLD)
    return (
        F.when(specific, F.lit(base))
        .when(operational, reject)
        .when(generic & (flag("has_placeholder_signal") | flag("has_template_language")), reject)
        .when(generic & flag("has_hash_or_identifier_term"), reject)
        .when(generic & contains_any(path, named_dumps), reject)
        .when(generic & flag("is_documentation_or_test_path"), reject)
        .when(
            generic & flag("is_assignment_context") & (bound | flag("has_asset_reference")),
            F.lit(C.GENERIC_BOUND_THRESHOLD),
        )
        .when(generic & bound & flag("has_asset_reference"), F.lit(C.GENERIC_ASSET_THRESHOLD))
        .when(generic, reject)
        .otherwise(F.lit(base))
    )


def probability(rows: DataFrame) -> Column:
    """Positive-class probability from whatever the model gave."""
    if "probability" in rows.columns:
        return vector_to_array(F.col("probability"))[1]
    if "rawPrediction" in rows.columns:
        return 1.0 / (1.0 + F.exp(-vector_to_array(F.col("rawPrediction"))[1]))
    return F.when(F.col("prediction").cast("int") == 1, F.lit(0.99)).otherwise(F.lit(0.01))


def supervised_scorer(
    model: LinearModel | Transformer,
    feature_order: Sequence[str] = C.FEATURE_ORDER,
    model_name: str = C.SUPERVISED_MODEL,
    approve_threshold: float = C.APPROVE_THRESHOLD,
) -> Scorer:
    """Scorer that applies a fitted model to the whole table at once.

    A linear model becomes one column expression over the features; any other one
    transforms a vector of them.
    """

    def with_probability(rows: DataFrame) -> tuple[DataFrame, list[str]]:
        if isinstance(model, LinearModel):
            columns = dict(zip(model.feature_order, encoded(rows, feature_order).values()))
            return rows.withColumn("raw_score", model.probability(columns)), []
        predicted = model.transform(assemble(rows, feature_order))
        made = [c for c in predicted.columns if c not in rows.columns]
        return predicted.withColumn("raw_score", probability(predicted)), made

    def score(rows: DataFrame) -> DataFrame:
        predicted, made = with_probability(rows)
        decided = decide(
            predicted.withColumn("_threshold", approval_threshold(rows, approve_threshold)),
            F.col("raw_score"),
            F.col("_threshold"),
            model_name,
        )
        # Two digits of the exact binary value, which the JVM would round differently.
        shown = F.lit("")
        for known in (
            approve_threshold, C.GENERIC_BOUND_THRESHOLD, C.GENERIC_ASSET_THRESHOLD, C.GENERIC_REJECT_THRESHOLD,
        ):
            shown = F.when(F.col("_threshold") == known, F.lit(f"{known:.2f}")).otherwise(shown)
        reasons = F.array(
            F.lit(f"supervised model probability from {model_name}"),
            F.concat(F.lit("approval threshold="), shown),
        )
        return decided.withColumn("reasons", reasons).drop("_threshold", *made)

    return score


def save_bundle(
    model: LinearModel | PipelineModel, path: str, feature_order: Sequence[str], model_name: str, metrics: dict
) -> str:
    """Folder with the model and a JSON text of what belongs to it; an earlier one stays until this is whole."""
    spark = SparkSession.active()
    root = path.rstrip("/")
    about = {"feature_order": list(feature_order), "model_name": model_name, "metrics": metrics}
    if isinstance(model, LinearModel):
        about["linear"] = json.loads(model.to_json())

    def write(folder: str) -> None:
        if "linear" not in about:
            model.write().save(f"{folder}/model")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/about")

    return publish(spark, root, write)


def load_bundle(
    path: str, feature_order: Sequence[str] | None = None, approve_threshold: float = C.APPROVE_THRESHOLD
) -> tuple[Scorer, dict]:
    """Scorer and side data of a saved bundle or a bare saved model.

    Feature order: the caller's, else the bundle's, else the default. A linear model
    takes its coefficients in the order of that list.
    """
    spark = SparkSession.active()
    root = path.rstrip("/")
    # A bare model has no such text; reading a folder that isn't there says so.
    try:
        about = json.loads(spark.read.text(f"{root}/about", wholetext=True).head()["value"])
    except AnalysisException:
        about = {}
    linear = about.pop("linear", None)
    if linear:
        model = LinearModel.from_json(json.dumps(linear))
    else:
        model = PipelineModel.load(f"{root}/model" if about else root)
    order = list(feature_order or about.get("feature_order") or C.FEATURE_ORDER)
    name = about.get("model_name", "spark-supervised-model")
    about = {"metrics": None, **about, "feature_order": order, "model_name": name}
    return supervised_scorer(model, order, name, approve_threshold), about

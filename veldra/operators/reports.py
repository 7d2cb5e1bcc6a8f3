"""Classifier reports: written as JSON, read by glob, rolled up to a row for each method and model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.operators import methods, models
from veldra.sources.stores import write_text

_FEATURE = "name string, importance double"
_MODEL = (
    "name string, cv_mean_accuracy double, cv_std_accuracy double, cv_mean_balanced_accuracy double, cv_std_balanced_accuracy double, cv_mean_f1 double, "
    "cv_improvement_over_baseline double, nonzero_feature_count int, feature_importances array<struct<name:string,importance:double>>"
)
SCHEMA = f"method string, n_samples int, n_pass int, n_fail int, baseline_accuracy double, best_model string, models array<struct<{_MODEL.replace(', ', ',').replace(' ', ':')}>>, {_MODEL.partition(', ')[2]}"


def report(method: str, benches: list, n_pass: int, n_fail: int, features: list[str]) -> str:
    """A bench as JSON."""
    baseline = max(n_pass, n_fail) / (n_pass + n_fail)
    models = []
    for b in benches:
        rows = [{"name": n, "importance": v} for n, v in b.importances]
        kept = [r for r in rows if r["importance"] > 0]
        models.append(
            {"name": b.name, "grid_size": b.grid_size, "best_params": b.best_params, **b.scores, "cv_improvement_over_baseline": b.scores["cv_mean_accuracy"] - baseline,
             "feature_importances": rows, "nonzero_feature_count": len(kept), "nonzero_features": kept, "tree_text": b.tree_text}
        )
    head = {"method": method, "n_samples": n_pass + n_fail, "n_pass": n_pass, "n_fail": n_fail, "baseline_accuracy": baseline, "feature_names": features}
    return json.dumps(head | {"best_model": benches[0].name, "models": models})


def write_report(spark: SparkSession, folder: str, method: str, text: str) -> str:
    """Put a report in its place in ``folder``, over an older one; its path."""
    path = f"{folder}/classifier_{method}_report.json"
    write_text(spark, path, text)
    return path


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of a folder with ``method`` by file name; what is no object is passed over."""
    found = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "classifier_*_report.json").json(folder)
    named = F.regexp_extract(F.col("_metadata.file_name"), r"^classifier_(.*)_report\.json$", 1)
    return found.select("*", named.alias("__m")).withColumn("method", F.col("__m")).drop("__m").where("n_samples IS NOT NULL OR models IS NOT NULL OR cv_mean_accuracy IS NOT NULL")


def summary(reports: DataFrame, pass_rates: DataFrame) -> DataFrame:
    """A row for each method and model, best balanced accuracy first, those without one last.

    Older reports hold one model in the report itself; it is read as a model named ``model``.
    """
    flat = F.struct(F.lit("model").alias("name"), *[F.col(c.strip().split(" ")[0]) for c in _MODEL.split(", ")[1:]])
    kind = reports.schema["models"].dataType
    models = F.when(F.size(F.coalesce("models", F.array().cast(kind))) > 0, F.col("models")).otherwise(F.array(flat).cast(kind))
    each = reports.select("method", "n_samples", "baseline_accuracy", "best_model", F.explode(models).alias("m"))
    kept = F.filter(F.coalesce("m.feature_importances", F.array().cast("array<struct<name:string,importance:double>>")), lambda x: x["importance"] > 0)
    rows = each.join(pass_rates, "method", "left").select(
        "method", F.col("m.name").alias("model"), F.coalesce(F.col("m.name") == F.col("best_model"), F.lit(False)).alias("is_best"), F.col("n_samples").alias("n"), "pass_rate",
        F.col("baseline_accuracy").alias("baseline"), F.col("m.cv_mean_accuracy").alias("cv_acc"), F.col("m.cv_mean_balanced_accuracy").alias("cv_bal_acc"), F.col("m.cv_mean_f1").alias("cv_f1"),
        F.col("m.cv_improvement_over_baseline").alias("delta_acc"), (F.col("m.cv_mean_balanced_accuracy") - 0.5).alias("delta_bal"),
        F.coalesce("m.nonzero_feature_count", F.size(kept)).alias("nonzero_count"), F.transform(F.slice(kept, 1, 5), lambda x: x["name"]).alias("top_features"),
    )
    return rows.orderBy(F.desc_nulls_last("cv_bal_acc"), F.desc_nulls_last("cv_acc"), "method", "model")


def pass_rates(results: DataFrame) -> DataFrame:
    """``(method, pass_rate)`` of ``results(method, passed)``."""
    return results.groupBy("method").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def method_list(spark: SparkSession, reports: DataFrame) -> DataFrame:
    """``(place, id, label, recommended, has_classifier)``: the methods on offer and which of them have a report."""
    known = reports.select(F.col("method").alias("id")).distinct().withColumn("has_classifier", F.lit(True))
    offered = spark.createDataFrame([(i, *m) for i, m in enumerate(methods.CATALOG)], "place int, id string, label string, recommended boolean")
    return offered.join(known, "id", "left").select("place", "id", "label", "recommended", F.coalesce("has_classifier", F.lit(False)).alias("has_classifier")).orderBy("place")


def pathways(examples: DataFrame, features: list[str], ids: list[str], model=None) -> list[dict]:
    """Chosen questions of ``examples`` (features, outcome and entry together) with some features and a tree's path, in the order of ``ids``."""
    rows = {r["id"]: r.asDict() for r in examples.where(F.col("id").isin(ids)).collect()}  # as many as were chosen
    nodes = models.tree_nodes(model, features) if model else []
    told = [{"id": i, "question": rows[i].get("question"), "passed": rows[i]["passed"], "features": {f: rows[i][f] for f in features}} for i in ids if i in rows]
    return [t | {"path": models.decision_path(nodes, t["features"])} if nodes else t for t in told]


def admin(method: str, rows: DataFrame, features: list[str], kind: str, params: dict, model, table: DataFrame) -> dict:
    """What an administrator sees of a method: its reports, importances, a tree's layout, confusion out of fold, a headline.

    ``rows(id, label, <features>)`` are judged questions and ``table`` a :func:`summary`.
    """
    confusion = models.out_of_fold_confusion(rows, features, kind, params).first().asDict()
    return {
        "method": method,
        "models": [r.asDict() for r in table.where(F.col("method") == method).collect()],  # a row for each kind of model
        "importances": [{"name": n, "importance": v} for n, v in models.importances(model, features)],
        "tree": models.tree_layout(models.tree_nodes(model, features)) if kind == "decision_tree" else [],
        "confusion": confusion,
        "headline": {"questions": confusion["n"], "accuracy": confusion["raw_accuracy"], "right_when_confident": confusion["confident_precision"], "wrong_answers_flagged": confusion["flag_catch_rate"]},
    }

"""Classifiers that estimate whether an answer can be trusted: folds, grids, metrics, explanations.

Questions with features are few (a row for each evaluated question), so model selection is a loop on the
driver over Spark ML fits; metrics are aggregations of out-of-fold predictions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED, MAX_FOLDS = 42, 5
#: Grid points that are tried at a time.
THREADS = 8
GRIDS = {
    "dummy_majority": [{}],
    "decision_tree": [{"depth": d, "leaf": m, "weight": w} for d, m, w in product((2, 3, 4), (4, 8), (None, "balanced"))],
    "logreg_l2": [{"c": c, "weight": w} for c, w in product((0.1, 1.0, 10.0), (None, "balanced"))],
    "logreg_l1": [{"c": c, "weight": w} for c, w in product((0.1, 1.0, 10.0), (None, "balanced"))],
}


def fold_count(n_pass: int, n_fail: int) -> int:
    """Folds for the counts of both classes; an error if a class has fewer than two rows."""
    n = min(MAX_FOLDS, n_pass, n_fail)
    if n < 2:
        raise ValueError("both classes need at least two rows")
    return n


def stratified_folds(rows: DataFrame, n: int, key: str = "id", label: str = "label") -> DataFrame:
    """``rows`` with ``fold``: each class dealt round in the order of ``md5(key)``."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(SEED)))), key)
    return rows.withColumn("fold", ((F.row_number().over(order) - 1) % n).cast("int"))


def metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy and F1 of class 1 for each group of ``predictions(label, prediction)``."""
    hit = lambda p, y: F.count_if((F.col("prediction") == p) & (F.col("label") == y))
    c = predictions.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select(*by, ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), ((over(tp, tp + fn) + over(tn, tn + fp)) / 2).alias("balanced_accuracy"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))


def fold_summary(per_fold: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of the folds' metrics."""
    names = ("accuracy", "balanced_accuracy", "f1")
    return per_fold.groupBy(*by).agg(*[f(m).alias(f"cv_{k}_{m}") for m in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))])


def label_counts(rows: DataFrame) -> dict[int, int]:
    return {int(r.label): r["count"] for r in rows.groupBy("label").count().collect()}  # two rows


def _weighted(rows: DataFrame, weight: str | None, n: dict[int, int]) -> DataFrame:
    if weight is None:
        return rows.withColumn("w", F.lit(1.0))
    total = sum(n.values())
    return rows.withColumn("w", F.when(F.col("label") == 1, total / (2.0 * n.get(1, 1))).otherwise(total / (2.0 * n.get(0, 1))))


def fit(rows: DataFrame, features: list[str], kind: str, params: dict, counts: dict[int, int] | None = None) -> PipelineModel | float:
    """A model of ``kind`` on all ``rows``; the dummy is the larger class. ``counts`` of the labels save a pass."""
    counts = counts or label_counts(rows)
    if kind == "dummy_majority":
        return float(min(counts, key=lambda y: (-counts[y], y)))
    weighted, n = _weighted(rows, params.get("weight"), counts), sum(counts.values())
    gather = VectorAssembler(inputCols=features, outputCol="x")
    if kind == "decision_tree":
        tree = DecisionTreeClassifier(featuresCol="x", maxDepth=params["depth"], minInstancesPerNode=params["leaf"], weightCol="w", maxBins=max(32, min(n, 1024)), seed=SEED)
        return Pipeline(stages=[gather, tree]).fit(weighted)
    scale = StandardScaler(inputCol="x", outputCol="z", withMean=True)
    net = 1.0 if kind == "logreg_l1" else 0.0
    model = LogisticRegression(featuresCol="z", weightCol="w", elasticNetParam=net, regParam=1.0 / (params["c"] * n), standardization=False, maxIter=200)
    return Pipeline(stages=[gather, scale, model]).fit(weighted)


def predict(model: PipelineModel | float, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction`` and ``p_pass``."""
    if isinstance(model, float):
        return rows.withColumn("prediction", F.lit(model)).withColumn("p_pass", F.lit(model))
    out = model.transform(rows.withColumn("w", F.lit(1.0)))
    return out.withColumn("p_pass", vector_to_array("probability")[1]).select(*rows.columns, "prediction", "p_pass")


def out_of_fold(rows: DataFrame, features: list[str], kind: str, params: dict, n: int, counts: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """Predictions of each fold by a model fitted on the others; ``counts`` of rows by fold and label save passes."""
    parts = []
    for k in range(n):
        others = {y: sum(c for (f, z), c in counts.items() if f != k and z == y) for y in (0, 1)} if counts else None
        parts.append(predict(fit(rows.where(F.col("fold") != k), features, kind, params, others), rows.where(F.col("fold") == k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_fold_confusion(rows: DataFrame, features: list[str], kind: str, params: dict) -> DataFrame:
    """One row: confusion counts and rates (:func:`evaluation.confusion`) of predictions that no row's own model made."""
    from veldra.operators.evaluation import confusion

    n = label_counts(rows)
    folds = fold_count(n.get(1, 0), n.get(0, 0))
    return confusion(out_of_fold(stratified_folds(rows, folds), features, kind, params, folds))


@dataclass
class Bench:
    """The winner of a kind's grid with its cross-validated metrics and importances."""

    name: str
    grid_size: int
    best_params: dict
    scores: dict
    importances: list[tuple[str, float]] = field(default_factory=list)
    tree_text: str = ""


def importances(model: PipelineModel | float, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance: a tree's gains, sizes of coefficients, zeros of the dummy."""
    if isinstance(model, float):
        return [(f, 0.0) for f in features]
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients.toArray()]
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: -x[1])


def bench(rows: DataFrame, features: list[str], kinds: dict | None = None, threads: int = THREADS) -> list[Bench]:
    """Every kind's best grid point by balanced accuracy, best kind first; ``rows(id, label, <features>)``.

    Fits are many and small: the rows stand in one cached partition and grid points are tried side by side.
    """
    n = label_counts(rows)
    folds = fold_count(n.get(1, 0), n.get(0, 0))
    dealt = stratified_folds(rows, folds).coalesce(1).cache()
    counts = {(r.fold, int(r.label)): r["count"] for r in dealt.groupBy("fold", "label").count().collect()}  # two rows a fold

    def tried(point: tuple[str, int, dict]) -> tuple:
        kind, place, params = point
        s = fold_summary(metrics(out_of_fold(dealt, features, kind, params, folds, counts), ["fold"]), []).first().asDict()
        return kind, s["cv_mean_balanced_accuracy"], -place, params, s

    grids = kinds or GRIDS
    with ThreadPool(threads) as pool:
        scores = pool.map(tried, [(kind, i, params) for kind, grid in grids.items() for i, params in enumerate(grid)], chunksize=1)
    out = []
    for kind, grid in grids.items():
        _, _, _, params, best = max((t for t in scores if t[0] == kind), key=lambda t: t[1:3])
        final = fit(dealt, features, kind, params, n)
        text = final.stages[-1].toDebugString if kind == "decision_tree" else ""
        out.append(Bench(kind, len(grid), params, best, importances(final, features), text))
    dealt.unpersist()
    return sorted(out, key=lambda b: (-b.scores["cv_mean_balanced_accuracy"], -b.scores["cv_mean_accuracy"]))


def tree_nodes(model: PipelineModel, features: list[str]) -> list[dict]:
    """The nodes of a fitted tree: id, feature and threshold or none for a leaf, children, impurity, counts."""
    out: list[dict] = []

    def walk(node, depth: int) -> int:
        me = {"id": len(out), "depth": depth, "prediction": node.prediction(), "impurity": node.impurity(), "feature": None, "threshold": None, "left": None, "right": None}
        me["counts"] = [float(x) for x in node.impurityStats().stats()]
        out.append(me)
        if node.subtreeDepth() > 0:
            split = node.split()
            me["feature"], me["threshold"] = features[split.featureIndex()], split.threshold()
            me["left"], me["right"] = walk(node.leftChild(), depth + 1), walk(node.rightChild(), depth + 1)
        return me["id"]

    walk(model.stages[-1]._java_obj.rootNode() if hasattr(model.stages[-1], "_java_obj") else model.stages[-1]._call_java("rootNode"), 0)
    return out


def decision_path(nodes: list[dict], row: dict) -> list[dict]:
    """The steps a row takes from the root to its leaf."""
    path, at = [], nodes[0]
    while at["feature"] is not None:
        value = float(row[at["feature"]])
        left = value <= at["threshold"]
        path.append({"feature": at["feature"], "threshold": at["threshold"], "value": value, "direction": "left" if left else "right", "impurity": at["impurity"], "samples": sum(at["counts"])})
        at = nodes[at["left"] if left else at["right"]]
    return [*path, {"feature": None, "prediction": at["prediction"], "impurity": at["impurity"], "samples": sum(at["counts"]), "counts": at["counts"]}]


def tree_layout(nodes: list[dict]) -> list[dict]:
    """Nodes with ``x`` by in-order position and ``y`` by depth."""
    order: list[int] = []

    def visit(i: int | None) -> None:
        if i is not None:
            visit(nodes[i]["left"])
            order.append(i)
            visit(nodes[i]["right"])

    visit(0)
    return [nodes[i] | {"x": x, "y": nodes[i]["depth"]} for x, i in enumerate(order)]


def contributions(model: PipelineModel, features: list[str], row: dict, top: int = 10) -> list[tuple[str, float]]:
    """What each feature adds to a logistic model's score for a row: scaled value times coefficient, largest first."""
    scaler, last = model.stages[-2], model.stages[-1]
    mean, std, coef = scaler.mean.toArray(), scaler.std.toArray(), last.coefficients.toArray()
    added = [(f, float((float(row[f]) - m) / s * c) if s else 0.0) for f, m, s, c in zip(features, mean, std, coef, strict=True)]
    return sorted([a for a in added if abs(a[1]) > 1e-9], key=lambda a: -abs(a[1]))[:top]


def tree_contributions(model: PipelineModel, features: list[str], path: list[dict], top: int = 10) -> list[tuple[str, float, bool]]:
    """A tree's features of any importance, each with whether a row's path passed it."""
    used = {p["feature"] for p in path}
    return [(f, v, f in used) for f, v in importances(model, features) if v > 0][:top]

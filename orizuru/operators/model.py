"""Predict quality from staff history by gradient-boosted trees, with exact attribution of each prediction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orizuru.functions.expressions import exact_sum, rnd
from orizuru.operators.history import FEATURES
from orizuru.operators.ranking import placed


def assemble(matrix: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(matrix)


def fit(matrix: DataFrame, columns: list[str] = FEATURES, trees: int = 100, rate: float = 0.05, depth: int = 4, seed: int = 42) -> GBTRegressionModel:
    """Boosted regression trees on `matrix` (columns, z). Rows are ordered by work, so a seed gives one model."""
    n = matrix.count()
    least = min(5, max(2, n // 5))
    data = assemble(matrix, columns).select("work_id", "features", F.col("z").alias("label")).orderBy("work_id")
    return GBTRegressor(maxIter=trees, stepSize=rate, maxDepth=depth, featureSubsetStrategy="0.8", subsamplingRate=1.0, minInstancesPerNode=least, seed=seed).fit(data)


def predict(matrix: DataFrame, model: GBTRegressionModel, columns: list[str] = FEATURES) -> DataFrame:
    """`matrix` with predicted_z; missing features count as 0."""
    return model.transform(assemble(matrix.fillna(0.0, list(columns)), columns)).withColumnRenamed("prediction", "predicted_z").drop("features")


def metrics(rows: DataFrame, truth: str = "z", predicted: str = "predicted_z") -> DataFrame:
    """rmse, mae, r2, pearson, spearman (0 for two rows or fewer, or without variation) over all rows."""
    e = F.col(truth) - F.col(predicted)
    ranked = rows.select(truth, predicted)
    for c, r in ((truth, "rt"), (predicted, "rp")):  # mean rank of equal values
        numbered = placed(ranked, [F.col(c)], "_place")
        ranked = numbered.join(numbered.groupBy(c).agg(F.avg("_place").alias(r)), c).drop("_place")
    few = (F.count("*") <= 2) | (F.stddev_pop(truth) <= 1e-6) | (F.stddev_pop(predicted) <= 1e-6)
    return ranked.agg(
        rnd(F.sqrt(F.avg(e * e)), 6).alias("rmse"), rnd(exact_sum(F.abs(e)) / F.count("*"), 6).alias("mae"),
        rnd(1 - F.sum(e * e) / (F.count("*") * F.var_pop(truth)), 6).alias("r2"),
        rnd(F.when(few, 0.0).otherwise(F.corr(truth, predicted)), 6).alias("pearson"), rnd(F.when(few, 0.0).otherwise(F.corr("rt", "rp")), 6).alias("spearman"),
    )


def _trees(model: GBTRegressionModel) -> list[dict]:
    """Nodes of each tree as arrays: feature, threshold, left, right, value, cover."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

        def walk(node) -> int:
            at = len(nodes["value"])
            for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", node.prediction() * weight), ("cover", float(node.impurityStats().count()))):
                nodes[k].append(v)
            if node.subtreeDepth() > 0:
                nodes["feature"][at] = node.split().featureIndex()
                nodes["threshold"][at] = node.split().threshold()
                nodes["left"][at] = walk(node.leftChild())
                nodes["right"][at] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        out.append({k: np.array(v) for k, v in nodes.items()})
    return out


class _Leaf:
    """A leaf with the bounds that its path sets to each of its features, and the Shapley values for every combination
    of features whose bounds hold.

    The leaf counts with a product over its features: the share of cover where a feature is unknown, whether its bounds
    hold where it is known. With d features the Shapley weights are those of subsets of d, by polynomial coefficients;
    as a feature's bounds hold or don't, 2**d rows of d values tell all.
    """

    def __init__(self, value: float, path: dict[int, tuple[float, float, float]]):
        self.features = list(path)
        self.low, self.high, shares = (np.array([p[k] for p in path.values()]) for k in range(3)) if path else (np.zeros(0),) * 3
        d = len(path)
        self.base = value * float(np.prod(shares))
        self.table = np.zeros((1 << d, d))
        weights = np.array([1.0 / (d * _choose(d - 1, k)) for k in range(d)])
        for held in range(1 << d):
            ones = [float(held >> i & 1) for i in range(d)]
            for i in range(d):
                poly = np.ones(1)  # coefficient k: sum over subsets of the others with k known features
                for j in range(d):
                    if j != i:
                        poly = np.convolve(poly, (shares[j], ones[j]))
                self.table[held, i] = value * (ones[i] - shares[i]) * float((poly * weights).sum())


def _leaves(tree: dict) -> list[_Leaf]:
    out: list[_Leaf] = []

    def descend(at: int, path: dict[int, tuple[float, float, float]]) -> None:
        f = int(tree["feature"][at])
        if f < 0:
            out.append(_Leaf(float(tree["value"][at]), path))
            return
        left, right, split = tree["left"][at], tree["right"][at], float(tree["threshold"][at])
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        cover = tree["cover"][left] + tree["cover"][right]
        descend(left, path | {f: (low, min(high, split), share * tree["cover"][left] / cover)})
        descend(right, path | {f: (max(low, split), high, share * tree["cover"][right] / cover)})

    descend(0, {})
    return out


def shapley(x: np.ndarray, leaves: list[_Leaf]) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values of all rows of `x`, and the base value."""
    out = np.zeros_like(x)
    for leaf in leaves:
        f = leaf.features
        if f:
            held = (x[:, f] > leaf.low) & (x[:, f] <= leaf.high)
            np.add.at(out, (slice(None), f), leaf.table[held @ (1 << np.arange(len(f)))])
    return out, sum(leaf.base for leaf in leaves)


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def attribute(matrix: DataFrame, model: GBTRegressionModel, columns: list[str] = FEATURES) -> DataFrame:
    """(work_id, feature, value, shap, base_value): exact attributions, their sum with the base is the prediction."""
    shared = matrix.sparkSession.sparkContext.broadcast([leaf for tree in _trees(model) for leaf in _leaves(tree)])
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(columns))
            shap, base = shapley(x, shared.value)
            base = np.full(len(x), base)
            ids = np.repeat(np.array(batch.column(0).to_pylist(), object), len(columns))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(columns * len(x), pa.string()), pa.array(x.ravel()), pa.array(shap.ravel()), pa.array(np.repeat(base, len(columns)))],
                names=["work_id", "feature", "value", "shap", "base_value"],
            )

    arrays = assemble(matrix.fillna(0.0, columns), columns).select("work_id", vector_to_array("features").alias("x"))
    return arrays.mapInArrow(run, "work_id string, feature string, value double, shap double, base_value double")


def top_factors(shap: DataFrame, n: int = 5) -> DataFrame:
    """The n strongest positive and negative attributions of each work, by absolute value."""
    side = F.when(F.col("shap") > 0, "positive").when(F.col("shap") < 0, "negative")
    rows = shap.withColumn("side", side).where("side is not null")
    order = W.partitionBy("work_id", "side").orderBy(F.abs("shap").desc(), "feature")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("work_id", "side", "place", "feature", "value", "shap")


def importances(model: GBTRegressionModel, spark, columns: list[str] = FEATURES) -> DataFrame:
    values = model.featureImportances.toArray()
    rows = [(c, float(v / (values.sum() + 1e-6))) for c, v in zip(columns, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def shown_factors(shap: DataFrame, least: float = 0.003, n: int = 6) -> DataFrame:
    """What a chart shows of each work: the n strongest attributions above `least`, placed by value."""
    rows = shap.where(F.abs("shap") > least).withColumn("_k", F.row_number().over(W.partitionBy("work_id").orderBy(F.abs("shap").desc(), "feature"))).where(F.col("_k") <= n)
    place = F.row_number().over(W.partitionBy("work_id").orderBy(F.col("shap").desc(), "feature"))
    return rows.withColumn("place", place).select("work_id", "place", "feature", "value", "shap")


def fallback_attribution(predicted: DataFrame, weights: DataFrame, base: float) -> DataFrame:
    """(work_id, feature, shap) without a model to explain: what a prediction is above `base`, by the weight of each
    feature; in equal parts where no weights are known (an empty table means all features weigh alike)."""
    known = weights.select("feature", F.col("importance").alias("w"))
    total = known.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("t"))
    rows = predicted.select("work_id", (F.col("predicted_z") - base).alias("d")).join(F.broadcast(total))  # one row
    return rows.join(F.broadcast(known)).select("work_id", "feature", (F.col("w") / (F.col("t") + 1e-6) * F.col("d")).alias("shap"))  # a row for each feature


#: Names of features in reports.
ROLE_LABELS = {"director": "監督", "series_comp": "シリーズ構成", "char_design": "キャラクターデザイン", "unit_director": "演出陣", "sakkan": "作画監督", "music": "音楽", "art_dir": "美術監督"}
GENGA_LABELS = {
    "genga_weighted_s": "原画陣 加重過去実績実力値 S(a)", "genga_top_density": "原画陣 トップタレント比率 (D_top)", "genga_max_s": "原画陣 最高実力アニメーター S",
    "genga_total_count": "原画総参加人数", "genga_experienced_ratio": "原画過去実績保有率", "genga_sum_weights": "原画陣 参加話数比率総和",
}


def labels() -> dict[str, str]:
    """The label of each feature; those of a role are made of its name and of what the column holds."""
    mean = {"director": "スコア", "series_comp": "スコア", "sakkan": "スコア"}
    out = dict(GENGA_LABELS)
    for role, name in ROLE_LABELS.items():
        peak, count = (" (Peak)", "監督作品数") if role == "director" else ("", "作品数")
        out |= {
            f"{role}_bayesian_s": f"{name} 総合実力スコア S(a)", f"{role}_mean_z": f"{name} 過去実績平均{mean.get(role, '')}",
            f"{role}_max_z": f"{name} 過去最高実績{'スコア' if role in mean else ''}{peak}", f"{role}_past_count": f"{name} 過去{count}",
        }
    return out


def labelled(rows: DataFrame) -> DataFrame:
    """`rows` with the label of each feature; a feature without one keeps its name."""
    known = F.create_map(*[F.lit(x) for pair in labels().items() for x in pair])
    return rows.withColumn("label", F.coalesce(known[F.col("feature")], F.col("feature")))

"""PCA, LSA and correspondence analysis."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.blocks import pieces, rows_of, sums
from textloom.operators.sampling import rank_all
from textloom.runtime import materialise

@dataclass
class Decomposition:
    """``loadings`` (feature, component, loading), ``scores`` (doc_id, <prefix>_0.., <prefix>: the largest), shares of variance."""

    loadings: DataFrame
    scores: DataFrame
    explained: list[float]


def _leading(apply: Callable[[np.ndarray], np.ndarray], width: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Largest k eigenvalues and vectors of a symmetric positive operator, by a restarted block Krylov space.

    ``apply`` gives the operator times (width, l) and is a pass over the rows. A space as wide as the operator is
    exact at once; else the best vectors start the next space, until their residuals are within 1e-9 of the largest
    value.
    """
    block = min(width, k + 10)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, block)))[0]
    while True:
        basis, images, last = np.zeros((width, 0)), np.zeros((width, 0)), q
        while last.shape[1] and basis.shape[1] < min(width, 8 * block):
            image = apply(last)
            basis, images = np.hstack([basis, last]), np.hstack([images, image])
            left = image - basis @ (basis.T @ image)
            left -= basis @ (basis.T @ left)
            u, s, _ = np.linalg.svd(left, full_matrices=False)
            last = u[:, s > 1e-11 * max(1.0, np.abs(image).max())][:, : width - basis.shape[1]]
        small = basis.T @ images
        values, z = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[:block]
        v = basis @ z[:, best]
        rest = np.linalg.norm(images @ z[:, best[:k]] - v[:, :k] * values[best[:k]], axis=0)
        if not last.shape[1] or (rest <= 1e-9 * max(values.max(), 1e-300)).all():
            return np.maximum(values[best[:k]], 0), v[:, :k]
        q = np.linalg.qr(v)[0]


def _project(features: DataFrame, width: int, v: np.ndarray, shift: np.ndarray) -> DataFrame:
    """(doc_id, z): the rows' scores, from whole batches of sparse rows."""
    sent = features.sparkSession.sparkContext.broadcast((v, shift))

    def run(batches):
        m, s = sent.value
        for batch in (b for whole in batches for b in pieces(whole, 1)):
            z = rows_of(batch.column(1), width).times(m) - s
            ends = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], ["doc_id", "z"])

    return features.select("doc_id", "features").mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, z array<double>")


def _decompose(features: DataFrame, names: list[str] | None, k: int, prefix: str, centre: bool) -> Decomposition:
    """k right singular vectors of the (centred) rows; the sign makes each one's largest loading positive.

    Rows stay sparse and where they are: a pass multiplies a block of vectors by the rows and back, and only sums as
    large as that block travel. Centring is done on the products. An empty table has no components.
    """
    spark = features.sparkSession
    features = materialise(features, "features")
    first = features.filter("features is not null").select("features").first()
    width = int(first[0].size) if first else 0
    n, total, squares = (0, np.zeros(0), np.zeros(0)) if not width else sums(features, width, lambda x: [np.array(float(len(x))), np.bincount(x.index, x.value, width), np.bincount(x.index, x.value**2, width)])
    n = int(n)
    mean = total / max(n, 1)
    variance = (squares - n * mean**2) / max(n - 1, 1)
    k = min(k, width, n)
    if k:
        centre_of = mean if centre else np.zeros(width)

        def apply(q: np.ndarray) -> np.ndarray:
            sent = spark.sparkContext.broadcast(q)
            out = sums(features, width, lambda x: [x.left_times(x.times(sent.value))])[0].T
            sent.unpersist()
            return out - n * np.outer(centre_of, centre_of @ q)

        v = _leading(apply, width, k)[1]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    else:
        v = np.zeros((width, 0))
    scores = _project(features, width, v, mean @ v if centre else np.zeros(k))
    columns = [F.col("z")[i].alias(f"{prefix}_{i}") for i in range(k)]
    top = F.concat(F.lit(f"{prefix}_"), (F.array_position("z", F.array_max("z")) - 1).cast("string")).alias(prefix)
    wide = scores.select("doc_id", *columns, top)
    names = [str(i) for i in range(width)] if names is None else names
    rows = [(names[j], i, float(v[j, i])) for i in range(k) for j in range(width)]
    loadings = spark.createDataFrame(rows, "feature string, component int, loading double")
    spread = wide.agg(*[F.var_samp(f"{prefix}_{i}").alias(f"v{i}") for i in range(k)]).first() if k else []
    every = float(variance.sum())
    return Decomposition(loadings, wide, [float(x or 0) / every if every else 0.0 for x in spread])


def pca(features: DataFrame, names: list[str] | None = None, k: int = 20) -> Decomposition:
    return _decompose(features, names, k, "pca", True)


def lsa(features: DataFrame, names: list[str] | None = None, k: int = 20) -> Decomposition:
    return _decompose(features, names, k, "lsa", False)


def top_features(d: Decomposition, n: int = 10) -> DataFrame:
    """(component, rank, feature, loading)."""
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("loading"), "feature"))
    return d.loadings.withColumn("rank", rank).filter(F.col("rank") <= n).select("component", "rank", "feature", "loading")


def top_documents(scores: DataFrame, prefix: str, n: int = 5) -> DataFrame:
    """(component, rank, doc_id, score): of the documents whose largest component it is, those of the highest scores."""
    parts = [c for c in scores.columns if c.startswith(f"{prefix}_")]
    score = F.coalesce(*[F.when(F.col(prefix) == c, F.col(c)) for c in parts])
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("score"), "doc_id"))
    return scores.select(F.col(prefix).alias("component"), "doc_id", score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= n).select("component", "rank", "doc_id", "score")


def correspondence_analysis(edges: DataFrame, n: int = 1, row: str = "src", column: str = "dst", weight: str = "w") -> DataFrame:
    """(node, mca_1 .. mca_n): row factor scores of an edge table, largest first dimension first.

    Singular vectors of the standardised residuals D_r^-1/2 (P - r c') D_c^-1/2. Rows of the edge table become sparse
    rows over its columns, and the vectors come from passes over them, as in ``pca``; the residuals' centre is taken
    off the products. What reaches the driver is as wide as the columns, which are numbered in their order. Null ends
    and weights that aren't positive are left out; rows are labelled as rows.
    """
    spark: SparkSession = edges.sparkSession
    cells = edges.groupBy(F.col(row).cast("string").alias("r"), F.col(column).cast("string").alias("c")).agg(F.sum(F.col(weight).cast("double")).alias("w")).filter("w > 0 and r is not null and c is not null")
    cells = materialise(cells, "cells")
    total = cells.agg(F.sum("w")).first()[0]
    if not total:
        return spark.createDataFrame([], "node string" + "".join(f", mca_{i + 1} double" for i in range(n)))
    index = materialise(rank_all(cells.groupBy("c").agg(F.sum("w").alias("cw")), [F.col("c")], "idx").select("c", "cw", "idx"), "columns")
    mass = np.array([r.cw for r in index.orderBy("idx").collect()]) / total
    width = len(mass)
    lists = cells.join(index.select("c", "idx", "cw"), "c").groupBy("r").agg(F.sum("w").alias("rw"), F.array_sort(F.collect_list(F.struct("idx", (F.col("w") / F.sqrt("cw")).alias("x")))).alias("v"))
    # rows of (P / sqrt(r c)): w / sqrt(rw cw); the residual takes sqrt(r) sqrt(c)' off it
    scaled = lists.select(F.col("r").alias("doc_id"), F.col("rw"), F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), F.transform("v", lambda x: x["idx"].cast("int")).alias("indices"), F.transform("v", lambda x: x["x"] / F.sqrt(F.col("rw"))).alias("values")).alias("features"))
    rows = materialise(scaled, "residuals")
    count = rows.count()
    root = np.sqrt(mass)
    k = min(n, width, count)

    def apply(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(q)
        out = sums(rows, width, lambda x: [x.left_times(x.times(sent.value))])[0].T
        sent.unpersist()
        return out - np.outer(root, root @ q)  # (S - s c')'(S - s c') = S'S - c c', as S's = c and s's = 1

    values, v = _leading(apply, width, k)
    # scores: (S - sqrt(r) sqrt(c)') v / sqrt(r)
    z = _project(rows, width, v, np.zeros(k)).join(rows.select("doc_id", "rw"), "doc_id")
    shift = root @ v
    factors = z.select(F.col("doc_id").alias("node"), *[(F.col("z")[i] / F.sqrt(F.col("rw") / total) - float(shift[i])).alias(f"mca_{i + 1}") for i in range(k)])
    factors = materialise(factors, "factors")
    ends = factors.agg(*[f(f"mca_{i + 1}").alias(f"{f.__name__}{i}") for i in range(k) for f in (F.min, F.max)]).first()
    for i in range(k):
        if abs(ends[f"min{i}"]) > abs(ends[f"max{i}"]):
            factors = factors.withColumn(f"mca_{i + 1}", -F.col(f"mca_{i + 1}"))
    return factors.orderBy(F.desc("mca_1"), "node")

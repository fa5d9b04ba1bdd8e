"""Pointwise mutual information of terms with an outcome, and what builds on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.tfidf import Corpus
from textloom.runtime import materialise

METRICS = [
    "MI1", "MI0", "total", "total_pos_with_term", "total_neg_with_term", "total_pos_neg_with_term_diff", "pct_with_term", "pct_pos_with_term", "pct_neg_with_term",
    "pct_pos_neg_with_term_diff", "pct_pos_neg_with_term_ratio", "pct_term_pos", "pct_term_neg", "pct_term_pos_neg_diff", "pct_term_pos_neg_ratio",
]


def _metrics(t: Column, y1: Column, y0: Column, x1: Column, a: Column, b: Column, smooth: float, normalize: bool) -> dict[str, Column]:
    """The fifteen columns from the totals: T, of each class, of the term, and of the term in each class."""
    div = F.try_divide

    def mi(joint: Column, side: Column) -> Column:
        p = div(joint, t)
        ratio = div(p, div(x1, t) * div(side, t)) + smooth
        value = F.when(ratio > 0, F.log2(F.when(ratio > 0, ratio))).otherwise(F.when(ratio.isNotNull(), 0.0))
        return div(value, -F.log2(F.when(p > 0, p))) if normalize else value

    return {
        "MI1": mi(a, y1), "MI0": mi(b, y0), "total": x1, "total_pos_with_term": a, "total_neg_with_term": b, "total_pos_neg_with_term_diff": a - b, "pct_with_term": div(x1, t),
        "pct_pos_with_term": div(a, y1), "pct_neg_with_term": div(b, y0), "pct_pos_neg_with_term_diff": div(a, y1) - div(b, y0), "pct_pos_neg_with_term_ratio": div(div(a, y1), div(b, y0)),
        "pct_term_pos": div(a, x1), "pct_term_neg": div(b, x1), "pct_term_pos_neg_diff": div(a, x1) - div(b, x1), "pct_term_pos_neg_ratio": div(a, b),
    }


def mutual_info(features: DataFrame, outcome: DataFrame, l: float = 0.0, normalize: bool = True) -> DataFrame:  # noqa: E741
    """(term, the fifteen metrics).

    ``features`` is (doc_id, term, x), ``outcome`` (doc_id, y, w) with y 0 or 1. Texts without an outcome are left
    out, null weights are 0. ``l`` is added to the ratio inside the logarithm. Undefined quotients are null. One join
    and one aggregation with map-side sums; the totals are two numbers.
    """
    o = outcome.filter(F.col("y").isNotNull()).select("doc_id", F.col("y").cast("int").alias("y"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    totals = o.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("t"), F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("w"))), F.lit(0.0)).alias("y1"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("w"))), F.lit(0.0)).alias("y0"))
    wx = F.col("w") * F.col("x")
    sums = features.join(o, "doc_id").groupBy("term").agg(F.sum(wx).alias("x1"), F.sum(F.when(F.col("y") == 1, wx).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("y") == 0, wx).otherwise(0.0)).alias("b"))
    both = sums.crossJoin(F.broadcast(totals))
    m = _metrics(*(F.col(c) for c in ("t", "y1", "y0", "x1", "a", "b")), l, normalize)
    return both.select("term", *[v.alias(k) for k, v in m.items()])


def corpus_mutual_info(corpus: Corpus, outcome_col: str, weight_col: str | None = None, sample_size: int | None = None, l: float = 0.0, normalize: bool = True, seed: int = 0, binary: bool = False) -> DataFrame:  # noqa: E741
    """``mutual_info`` over the corpus's weights (or its presences). The sample is drawn by hashed ids."""
    rows = corpus.df.select(F.col(corpus.id_col).alias("doc_id"), F.col(outcome_col).alias("y"), (F.col(weight_col) if weight_col else F.lit(1.0)).alias("w"))
    if sample_size is not None:
        rows = rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))).limit(sample_size)
    x = F.lit(1.0) if binary else F.col("weight")
    return mutual_info(corpus.postings.select("doc_id", "term", x.alias("x")), rows, l, normalize)


def related_keywords(corpus: Corpus, keyword: str, n: int = 25, ignore_case: bool = False) -> DataFrame:
    """The terms that tell texts with the keyword from the others, the keyword among them."""
    pattern = ("(?i)" if ignore_case else "") + r"(?<![\p{L}\p{N}_])\Q" + keyword + r"\E(?![\p{L}\p{N}_])"
    marked = Corpus(corpus.df.withColumn("__has", F.col(corpus.text_col).rlike(pattern).cast("int")), corpus.id_col, corpus.text_col, corpus.options)
    marked._rows, marked._n = corpus.rows, corpus.n
    found = corpus_mutual_info(marked, "__has").filter(F.round("MI1", 9) > 0)
    return found.orderBy(F.desc(F.round("MI1", 9)), "term").limit(n)


def cluster_terms(corpus: Corpus, cluster: DataFrame, min_size: int = 50, top_n: int = 10, binary: bool = False) -> DataFrame:
    """(cluster, rank, term, MI1): the best terms of each cluster against all other texts.

    ``cluster`` is (doc_id, cluster). All clusters are done in one aggregation: what lies outside a cluster is the
    total less what lies inside.
    """
    c = cluster.filter("cluster is not null")
    sizes = c.groupBy("cluster").agg(F.count("*").cast("double").alias("y1"))
    t = sizes.agg(F.sum("y1").alias("t"))
    x = F.lit(1.0) if binary else F.col("weight")
    inside = materialise(corpus.postings.select("doc_id", "term", x.alias("x")).join(c, "doc_id").groupBy("cluster", "term").agg(F.sum("x").alias("a")), "cluster-terms")
    total = inside.groupBy("term").agg(F.sum("a").alias("x1"))
    both = inside.join(total, "term").join(F.broadcast(sizes.filter(F.col("y1") >= min_size)), "cluster").crossJoin(F.broadcast(t))
    m = _metrics(F.col("t"), F.col("y1"), F.col("t") - F.col("y1"), F.col("x1"), F.col("a"), F.col("x1") - F.col("a"), 0.0, True)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("MI1", 9)), "term"))
    return both.select("cluster", "term", m["MI1"].alias("MI1")).withColumn("rank", rank).filter((F.col("rank") <= top_n) & (F.round("MI1", 9) > 0)).select("cluster", "rank", "term", "MI1")


def bar_table(mi: DataFrame, filter_col: str = "MI1", top_n: int = 50, x_col: str = "pct_term_pos_neg_ratio") -> DataFrame:
    """The rows of a bar plot: the ``top_n`` by ``filter_col``, in the order of ``x_col``."""
    top = mi.filter(F.col(filter_col).isNotNull()).orderBy(F.desc(F.round(filter_col, 9)), "term").limit(top_n)
    return top.orderBy(F.desc_nulls_last(x_col), "term").select("term", filter_col, x_col)


def scatter_table(mi: DataFrame, filter_col: str = "MI1", top_n: int = 50, x_col: str = "pct_term_pos_neg_ratio", y_col: str = "MI1", scale_x_even: bool = True, scale_y_even: bool = True, size_col: str = "pct_pos_with_term", color_col: str = "MI1") -> DataFrame:
    """The rows of a scatter plot: ranks (or values) for x and y, size and colour scaled to 0..1."""
    top = mi.filter(F.col(filter_col).isNotNull()).orderBy(F.desc(F.round(filter_col, 9)), "term").limit(top_n)

    def place(c: str, even: bool) -> Column:
        return F.row_number().over(Window.orderBy(F.asc_nulls_first(F.round(c, 9)), "term")).cast("double") if even else F.col(c)

    def scaled(c: str) -> Column:
        every = Window.partitionBy()
        return F.try_divide(F.col(c) - F.min(c).over(every), F.max(c).over(every) - F.min(c).over(every))

    return top.select("term", place(x_col, scale_x_even).alias("x"), place(y_col, scale_y_even).alias("y"), scaled(size_col).alias("size"), scaled(color_col).alias("color"))

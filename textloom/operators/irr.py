"""Inter-rater reliability: sample sizes, pairwise and overall scores."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.runtime import require

_Z = NormalDist()


def kappa_sample_size_power(rate1: float, rate2: float, k1: float, k0: float, alpha: float = 0.05, power: float = 0.8, twosided: bool = False) -> int:
    """Documents needed to tell kappa k1 from k0 with two coders of these positive rates."""
    a, b = rate1, rate2
    na, nb = 1 - a, 1 - b
    pi = a * b + na * nb

    def q(k: float) -> float:
        p0 = k * (1 - pi) + pi
        p22 = (p0 - a + nb) / 2
        p11 = p0 - p22
        p12, p21 = a - p11, b - p11
        inner = p11 * (1 - pi - (a + b) * (1 - p0)) ** 2 + p22 * (1 - pi - (na + nb) * (1 - p0)) ** 2
        return (inner + (1 - p0) ** 2 * (p12 * (b + na) ** 2 + p21 * (nb + a) ** 2) - (p0 * pi - 2 * pi + p0) ** 2) / (1 - pi) ** 4

    za = _Z.inv_cdf(1 - alpha / (2 if twosided else 1))
    return math.ceil(((za * math.sqrt(q(k0)) + _Z.inv_cdf(power) * math.sqrt(q(k1))) / (k1 - k0)) ** 2)


def kappa_sample_size_ci(kappa0: float, kappaL: float, props: float | list[float], kappaU: float | None = None, alpha: float = 0.05) -> int:
    """Documents needed for a confidence interval of kappa0 that stays above kappaL; one more than the tested number."""
    if kappa0 == kappaL:
        raise ValueError("kappa0 and kappaL must differ")
    p = props[0] if isinstance(props, (list, tuple)) else props
    level = 1 - 2 * alpha if kappaU is None else 1 - alpha
    critical = _Z.inv_cdf((1 + level) / 2) ** 2

    def cells(r: float) -> tuple[float, float, float]:
        mixed = p * (1 - p)
        shared = r * mixed
        return (1 - p) ** 2 + shared, 2 * (mixed - shared), p * p + shared

    each = sum((x - y) ** 2 / y for x, y in zip(cells(kappa0), cells(kappaL)))
    n = 10
    while n * each < critical + 0.001:
        n += 1
    return n + 1


def _pairs(coders: DataFrame, coder1, coder2, outcome: str, doc: str, coder: str, weight: str | None, pos_label) -> DataFrame:
    """(doc, t, p, w) of the documents that both have coded: truth, prediction, and the first coder's weight."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    code = F.col(outcome).cast("string")
    if pos_label is not None:
        code = F.when(code == str(pos_label), "1").otherwise("0")
    one = coders.filter(F.col(coder) == coder1).select(F.col(doc).alias("doc"), code.alias("t"), w.alias("w"))
    two = coders.filter(F.col(coder) == coder2).select(F.col(doc).alias("doc"), code.alias("p"))
    return one.join(two, "doc")


def alpha_nominal(counts: list[tuple[object, str, int]]) -> float | None:
    """Krippendorff's alpha from (document, code, number of coders)."""
    by: dict = {}
    for d, c, n in counts:
        by.setdefault(d, {})[c] = by.setdefault(d, {}).get(c, 0) + n
    units = [u for u in by.values() if sum(u.values()) > 1]
    total: dict = {}
    for u in units:
        for c, n in u.items():
            total[c] = total.get(c, 0) + n
    n = sum(total.values())
    if n < 2:
        return None
    expected = (n * n - sum(v * v for v in total.values())) / (n * (n - 1))
    if expected == 0:
        return 1.0
    observed = sum((sum(u.values()) ** 2 - sum(v * v for v in u.values())) / (sum(u.values()) - 1) for u in units) / n
    return 1 - observed / expected


def krippendorff(coded: DataFrame) -> DataFrame:
    """(alpha) of (doc, code) rows, one for each coder's code of a document; nulls are left out.

    1 - De/Do from counts by document and code: one shuffle by document, sums of squares after that.
    """
    c = coded.filter(F.col("code").isNotNull()).groupBy("doc", "code").agg(F.count("*").alias("n"))
    units = c.groupBy("doc").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s"), F.collect_list(F.struct("code", "n")).alias("c")).filter("m > 1")
    observed = units.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"))
    codes = units.select(F.explode("c").alias("c")).groupBy("c.code").agg(F.sum("c.n").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    both = observed.crossJoin(codes)
    n = F.col("n").cast("double")
    expected = (n * n - F.col("k2")) / (n * (n - 1))
    return both.select(F.when(F.col("n").isNull(), None).when(n * n == F.col("k2"), 1.0).otherwise(1 - F.try_divide(F.col("o") / n, expected)).alias("alpha"))


def fleiss(coded: DataFrame, coders: int) -> DataFrame:
    """(fleiss_kappa) over the documents that have as many rows as there are coders."""
    c = coded.filter(F.col("code").isNotNull()).groupBy("doc", "code").agg(F.count("*").alias("n"))
    units = c.groupBy("doc").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s"), F.collect_list(F.struct("code", "n")).alias("c")).filter(F.col("m") == coders)
    agree = units.agg(F.avg((F.col("s") - coders) / F.lit(float(coders * (coders - 1)))).alias("po"), F.count("*").alias("d"))
    chance = units.select(F.explode("c").alias("c")).groupBy("c.code").agg(F.sum("c.n").cast("double").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    both = agree.crossJoin(chance)
    pe = F.try_divide(F.col("k2"), F.pow(F.col("d") * F.lit(float(coders)), F.lit(2.0)))
    return both.select(F.when(pe == 1, 1.0).otherwise(F.try_divide(F.col("po") - pe, 1 - pe)).alias("fleiss_kappa"))


def overall_scores(coder_df: DataFrame, outcome_column: str, document_column: str, coder_column: str) -> DataFrame:
    """(alpha, fleiss_kappa) of one coded column, in one row."""
    require(coder_df, outcome_column, document_column, coder_column)
    coded = coder_df.select(F.col(document_column).alias("doc"), F.col(outcome_column).cast("string").alias("code"))
    n = coder_df.select(coder_column).distinct().count()
    return krippendorff(coded).crossJoin(fleiss(coded, n))


def scores(coder_df: DataFrame, coder1, coder2, outcome_column: str, document_column: str, coder_column: str, weight_column: str | None = None, pos_label=None, strict: bool = False) -> DataFrame:
    """One row of agreement scores of two coders over the documents both coded; coder1 is the truth.

    All come from one weighted confusion matrix, which is the only thing brought to the driver (labels squared).
    ``alpha_unweighted`` takes in all coders of the table. Undefined precision, recall and F1 are 0, an undefined AUC
    null. The correlation is 1 where accuracy is 1 or a coder's codes don't vary (null for the latter if ``strict``).
    """
    require(coder_df, outcome_column, document_column, coder_column, *([weight_column] if weight_column else []))
    spark: SparkSession = coder_df.sparkSession
    pairs = _pairs(coder_df, coder1, coder2, outcome_column, document_column, coder_column, weight_column, pos_label)
    cells = [(r.t, r.p, float(r.w), r.n) for r in pairs.groupBy("t", "p").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()]
    every = coder_df.select(F.col(document_column).alias("doc"), F.col(outcome_column).cast("string").alias("code"))
    if pos_label is not None:
        every = every.withColumn("code", F.when(F.col("code").isNotNull(), F.when(F.col("code") == str(pos_label), "1").otherwise("0")))
    alpha = krippendorff(every).first()[0]
    row = score_cells(cells, weight_column is not None, pos_label is not None, strict)
    out = {"coder1": str(coder1), "coder2": str(coder2), "outcome_column": outcome_column, "pos_label": None if pos_label is None else str(pos_label), "alpha_unweighted": alpha, **row}
    kinds = {"coder1": "string", "coder2": "string", "outcome_column": "string", "pos_label": "string", "n": "long"}
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in out))


def score_cells(cells: list[tuple[str, str, float, int]], weighted: bool, binary: bool, strict: bool = False) -> dict:
    """The scores of a confusion matrix of (truth, prediction, weight, documents)."""
    n = sum(c[3] for c in cells)
    total = sum(c[2] for c in cells)
    labels = sorted({c[0] for c in cells} | {c[1] for c in cells})
    out: dict = {"n": n}

    def moments(side: int, weight: int) -> tuple[float | None, float | None]:
        try:
            values = [(float(c[side]), c[weight]) for c in cells]
        except ValueError:
            return None, None
        w = sum(v for _, v in values)
        if not w:
            return None, None
        mean = sum(x * v for x, v in values) / w
        variance = sum(v * (x - mean) ** 2 for x, v in values) / w
        return mean, (math.sqrt(variance) / math.sqrt(w - 1) if w > 1 else None)

    for i, coder in ((0, "coder1"), (1, "coder2")):
        out[f"{coder}_mean_unweighted"], out[f"{coder}_std_unweighted"] = moments(i, 3)
        out[f"{coder}_mean"], out[f"{coder}_std"] = moments(i, 2)
    t = {x: sum(c[2] for c in cells if c[0] == x) for x in labels}
    p = {x: sum(c[2] for c in cells if c[1] == x) for x in labels}
    hit = {x: sum(c[2] for c in cells if c[0] == c[1] == x) for x in labels}
    accuracy = sum(hit.values()) / total if total else None
    chance = sum(t[x] * p[x] for x in labels) / total**2 if total else None
    out["cohens_kappa"] = None
    if total and len(labels) <= 2:
        out["cohens_kappa"] = 1.0 if chance == 1 else (accuracy - chance) / (1 - chance)
    out["accuracy"] = accuracy
    precision = {x: hit[x] / p[x] if p[x] else 0.0 for x in labels}
    recall = {x: hit[x] / t[x] if t[x] else 0.0 for x in labels}
    f1 = {x: 2 * precision[x] * recall[x] / (precision[x] + recall[x]) if precision[x] + recall[x] else 0.0 for x in labels}
    for name, v in (("f1", f1), ("precision", precision), ("recall", recall)):
        if binary:
            out[name] = v.get("1", 0.0)
        else:
            out[name] = sum(t[x] * v[x] for x in labels) / total if total else None
    out["precision_recall_min"] = None if out["precision"] is None else min(out["precision"], out["recall"])
    mcc = None
    if total:
        s = sum(t[x] * p[x] for x in labels)
        a, b = total**2 - sum(v * v for v in p.values()), total**2 - sum(v * v for v in t.values())
        if accuracy == 1 or a <= 0 or b <= 0:
            mcc = None if strict and accuracy != 1 else 1.0
        else:
            mcc = (sum(hit.values()) * total - s) / math.sqrt(a * b)
    out["matthews_corrcoef"] = mcc
    out["roc_auc"] = None
    if len({c[0] for c in cells}) == 2 and len({c[1] for c in cells}) > 1 and len(labels) == 2:
        low, high = labels
        out["roc_auc"] = (recall[high] + recall[low]) / 2
    agree = sum(c[3] for c in cells if c[0] == c[1])
    out["pct_agree_unweighted"] = agree / n if n else None
    return out


DISTANCES = ("discrete", "jaccard", "masi", "cosine")


def _distance(name: str, a: Column, b: Column) -> Column:
    """Distance of two sets of labels."""
    both, any_ = F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")
    if name == "discrete":
        return F.when(F.array_sort(a) == F.array_sort(b), 0.0).otherwise(1.0)
    if name == "cosine":
        return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).otherwise(1 - F.coalesce(F.try_divide(both, F.sqrt(F.size(a).cast("double") * F.size(b))), F.lit(0.0)))
    share = F.when(any_ == 0, 1.0).otherwise(both / F.when(any_ == 0, 1.0).otherwise(any_))
    if name == "jaccard":
        return 1 - share
    least = F.least(F.size(a), F.size(b))
    m = F.when(F.array_sort(a) == F.array_sort(b), 1.0).when((both == least) & (least > 0), 0.67).when(both > 0, 0.33).otherwise(0.0)
    return 1 - share * m


def overall_scores_multivariate(coder_df: DataFrame, document_column: str, coder_column: str, outcome_columns: list[str]) -> DataFrame:
    """One row: alpha and multi-coder kappa under four distances of sets of codes, and ``fleiss_kappa_classic``.

    A coder's codes of a document are the set of ``column=value``; nulls are left out of it. Distances are worked out
    once for each pair of different sets and weighed by how often the pair occurs.
    """
    require(coder_df, document_column, coder_column, *outcome_columns)
    parts = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in outcome_columns]))))
    rows = coder_df.select(F.col(document_column).alias("doc"), F.col(coder_column).cast("string").alias("coder"), parts.alias("s")).persist()
    sizes = rows.groupBy("doc").agg(F.count("*").alias("m")).filter("m > 1")
    kept = rows.join(sizes, "doc")
    n = kept.count()
    a, b = kept.alias("a"), kept.alias("b")
    inside = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.coder") != F.col("b.coder"))).groupBy(F.col("a.s").alias("x"), F.col("b.s").alias("y")).agg(F.sum(1.0 / (F.col("a.m") - 1)).alias("w"))
    marginal = kept.groupBy("s").agg(F.count("*").alias("k"))
    across = marginal.select(F.col("s").alias("x"), F.col("k").alias("kx")).crossJoin(marginal.select(F.col("s").alias("y"), F.col("k").alias("ky"))).withColumn("w", F.col("kx") * F.col("ky") - F.when(F.col("x") == F.col("y"), F.col("kx")).otherwise(0))
    dist = [_distance(d, F.col("x"), F.col("y")) for d in DISTANCES]
    do = inside.agg(*[F.sum(F.col("w") * d).alias(f"d{i}") for i, d in enumerate(dist)]).first()
    de = across.agg(*[F.sum(F.col("w") * d).alias(f"d{i}") for i, d in enumerate(dist)]).first()
    coders = [r[0] for r in rows.select("coder").distinct().orderBy("coder").collect()]
    shares = {}
    for r in rows.groupBy("coder", "s").agg(F.count("*").alias("k")).collect():
        shares.setdefault(r.coder, {})[tuple(r.s)] = r.k
    pairs = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.coder") < F.col("b.coder"))).select(F.col("a.coder").alias("c1"), F.col("b.coder").alias("c2"), F.col("a.s").alias("x"), F.col("b.s").alias("y"))
    mean = pairs.groupBy("c1", "c2").agg(*[F.avg(d).alias(f"d{i}") for i, d in enumerate(dist)]).collect()
    ao = [sum(1 - r[f"d{i}"] for r in mean) / len(mean) if mean else None for i in range(len(DISTANCES))]
    ae = []
    for c1, c2 in itertools.combinations(coders, 2):
        n1, n2 = sum(shares[c1].values()), sum(shares[c2].values())
        ae.append(sum(k / n1 * shares[c2].get(s, 0) / n2 for s, k in shares[c1].items()))
    expected = sum(ae) / len(ae) if ae else None
    out: dict = {}
    for i, d in enumerate(DISTANCES):
        observed, chance = (do[i] or 0.0) / n if n else None, (de[i] or 0.0) / (n * (n - 1)) if n > 1 else None
        out[f"alpha_{d}"] = None if observed is None or chance is None else 1.0 if chance == 0 else 1 - observed / chance
        out[f"kappa_{d}"] = None if expected is None or ao[i] is None else 1.0 if expected == 1 else (ao[i] - expected) / (1 - expected)
    coded = rows.select("doc", F.array_join("s", "|").alias("code"))
    out["fleiss_kappa_classic"] = fleiss(coded, len(coders)).first()[0] if len(coders) > 1 else None
    rows.unpersist()
    return coder_df.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"{k} double" for k in out))

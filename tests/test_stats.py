import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import clustering, decomposition, irr, sampling, topics


def test_sample_sizes():
    assert irr.kappa_sample_size_power(rate1=0.4, rate2=0.5, k1=0.8, k0=0.7) == 271
    assert irr.kappa_sample_size_power(rate1=0.4, rate2=0.5, k1=0.8, k0=0.7, twosided=True) == 349
    assert irr.kappa_sample_size_ci(kappa0=0.8, kappaL=0.7, props=0.5) == 140
    assert irr.kappa_sample_size_ci(kappa0=0.8, kappaL=0.7, props=0.5, kappaU=0.9) == 197
    with pytest.raises(ValueError):
        irr.kappa_sample_size_ci(0.7, 0.7, 0.5)


CODES = {k: [int(c) for c in v] for k, v in {"code": "1011010100", "same": "1010010100", "flat": "1" * 10}.items()}
WEIGHT = [float(x) for x in "0.5 1.5 1 0.75 0.175".split()] * 2


@pytest.fixture(scope="module")
def coders(spark):
    rows = [(CODES["code"][i], CODES["same"][i], CODES["flat"][i], 1 + i // 5, WEIGHT[i], 1 + i % 5) for i in range(10)]
    return spark.createDataFrame(rows, "code int, same int, flat int, coder int, weight double, doc int")


def test_scores(coders):
    s = irr.scores(coders, 1, 2, outcome_column="code", document_column="doc", coder_column="coder", weight_column="weight", pos_label=1).first()
    want = {"cohens_kappa": 0.63, "matthews_corrcoef": 0.68, "accuracy": 0.81, "precision": 1.0, "recall": 0.67, "f1": 0.8, "roc_auc": 0.83, "coder1_mean": 0.57, "coder2_mean": 0.38, "coder1_std": 0.29, "coder2_std": 0.28, "coder1_mean_unweighted": 0.6, "coder2_mean_unweighted": 0.4, "coder1_std_unweighted": 0.24, "alpha_unweighted": 0.64, "pct_agree_unweighted": 0.8}
    assert {k: round(s[k], 2) for k in want} == want and s.n == 5


def test_scores_without_variation(coders):
    for column in ("same", "flat"):
        s = irr.scores(coders, 1, 2, column, document_column="doc", coder_column="coder", weight_column="weight", pos_label=1).first()
        assert (s.alpha_unweighted, s.cohens_kappa, s.matthews_corrcoef, s.f1) == (1.0, 1.0, 1.0, 1.0)
        assert s.roc_auc == (None if column == "flat" else 1.0)
    o = irr.overall_scores(coders, "code", "doc", "coder").first()
    assert (round(o.alpha, 2), round(o.fleiss_kappa, 2)) == (0.64, 0.6)


THREE = [("c1", 1, "2"), ("c1", 2, "1"), ("c1", 3, "0"), ("c2", 1, "2"), ("c2", 2, "2"), ("c2", 3, "0")]


@pytest.mark.parametrize(
    "label, want",
    [
        (None, {"alpha_unweighted": 0.545454, "cohens_kappa": None, "accuracy": 0.666667, "f1": 0.555556, "precision": 0.5, "recall": 0.666667, "matthews_corrcoef": 0.612372, "roc_auc": None, "coder1_mean": 1.0, "coder2_mean": 1.333333, "coder1_std": 0.57735, "coder2_std": 0.666667}),
        ("0", {"alpha_unweighted": 1.0, "cohens_kappa": 1.0, "accuracy": 1.0, "f1": 1.0, "matthews_corrcoef": 1.0, "roc_auc": 1.0}),
        ("1", {"alpha_unweighted": 0.0, "cohens_kappa": 0.0, "accuracy": 0.666667, "f1": 0.0, "precision": 0.0, "recall": 0.0, "matthews_corrcoef": 1.0, "roc_auc": None}),
        ("2", {"alpha_unweighted": 0.444444, "cohens_kappa": 0.4, "accuracy": 0.666667, "f1": 0.666667, "precision": 0.5, "recall": 1.0, "matthews_corrcoef": 0.5, "roc_auc": 0.75}),
    ],
)
def test_scores_of_three_documents(spark, label, want):
    df = spark.createDataFrame(THREE, "coder string, document int, code string")
    s = irr.scores(df, "c1", "c2", "code", document_column="document", coder_column="coder", pos_label=label).first()
    for k, v in want.items():
        assert s[k] == (None if v is None else pytest.approx(v, abs=1e-6)), k


def test_overall_goldens(spark):
    df = spark.createDataFrame(THREE, "coder string, document int, code string")
    o = irr.overall_scores(df, "code", "document", "coder").first()
    assert o.alpha == pytest.approx(0.545454, abs=1e-6) and o.fleiss_kappa == pytest.approx(0.454545, abs=1e-6)


def test_multivariate_goldens(spark):
    rows = [("c1", 1, "2", "1"), ("c1", 2, "1", "0"), ("c1", 3, "0", "0"), ("c2", 1, "2", "1"), ("c2", 2, "2", "1"), ("c2", 3, "0", "0")]
    m = irr.overall_scores_multivariate(spark.createDataFrame(rows, "coder string, document int, code1 string, code2 string"), "document", "coder", ["code1", "code2"]).first()
    assert [round(m[f"alpha_{d}"], 4) for d in irr.DISTANCES] == [0.5455, 0.5161, 0.5362, 0.5]
    assert [round(m[f"kappa_{d}"], 4) for d in irr.DISTANCES] == [0.5, 0.5, 0.5, 0.5]
    assert round(m.fleiss_kappa_classic, 4) == 0.4545


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, "abc"[(i * i) % 3 if i % 10 else 2], i % 2) for i in range(300)], "id long, s string, f int")


@pytest.mark.parametrize("strategy", ["random", "stratify", "stratify_even", "stratify_guaranteed"])
def test_samples(spark, frame, strategy):
    ids = lambda seed: sorted(r[0] for r in sampling.extract(frame, "id", 31, strategy, "s", seed).collect())
    a = ids(1)
    assert len(a) == len(set(a)) and a == ids(1) and a != ids(2) and 29 <= len(a) <= 31
    by = {r[0]: r[1] for r in frame.select("id", "s").collect()}
    counts = {s: sum(by[i] == s for i in a) for s in "abc"}
    if strategy == "stratify_even":
        assert min(counts.values()) >= 10 and len(a) == 31
    if strategy == "stratify_guaranteed":
        assert min(counts.values()) >= 1
    if strategy == "stratify":
        total = {s: sum(v == s for v in by.values()) for s in "abc"}
        assert all(abs(counts[s] - 31 * total[s] / 300) <= 1.5 for s in "abc")


def test_sample_arguments(frame):
    assert sampling.extract(frame, "id", 0.1).count() == 30 and sampling.extract(frame, "id", 5, "all").count() == 300
    assert sampling.extract(frame, "id", 2, "stratify_guaranteed", ["s"]).count() == 2
    with pytest.raises(ValueError):
        sampling.extract(frame, "id", 5, "other")
    with pytest.raises(ValueError):
        sampling.extract(frame, "id", 5, "stratify")


def test_weights(spark):
    tweets = spark.createDataFrame([(1, "R", 1), (2, "R", 1), (3, "D", 0), (4, "D", 0), (5, "D", 0)], "id int, party string, is_republican int")
    got = [r.weight for r in sampling.balanced_weights(tweets, ["is_republican"]).orderBy("id").collect()]
    assert got == pytest.approx([1.25, 1.25, 0.833333, 0.833333, 0.833333], abs=1e-6) and sum(got) == pytest.approx(5)
    frame = tweets.unionByName(tweets.filter("party = 'R'")).unionByName(tweets.filter("party = 'R'"))
    w = {r.id: r.weight for r in sampling.weights_from_frame(frame, tweets, ["party"]).collect()}
    assert w[1] == pytest.approx((6 / 9) / (2 / 5)) and w[3] == pytest.approx((3 / 9) / (3 / 5))
    assert {r.weight for r in sampling.weights_from_frame(frame, tweets, []).collect()} == {1.0}


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 6, 6))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_clusters(blobs):
    x, df = blobs
    f = clustering.array_features(df, "id", "v")
    labels, score = clustering.kmeans(f, 3, seed=3, return_score=True)
    by = {r.doc_id: r.cluster for r in labels.collect()}
    assert all(len({by[i] for i in range(s, s + 40)}) == 1 for s in (0, 40, 80)) and len(set(by.values())) == 3 and score > 0.8
    dense = {r.doc_id: r.cluster for r in clustering.hdbscan(f, min_cluster_size=10).collect()}
    for s in (0, 40, 80):
        inside = [dense[i] for i in range(s, s + 40) if dense[i] >= 0]
        assert len(set(inside)) == 1 and len(inside) > 25
    assert len({v for v in dense.values() if v >= 0}) == 3
    assert set(clustering.hdbscan_labels(x[:5], 10)) == {-1}


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_density_clusters_in_blocks(blobs, block):
    """Blocks of rows give what all rows in memory give, whatever the names of the clusters."""
    x, df = blobs
    got = {r.doc_id: r.cluster for r in clustering.hdbscan(clustering.array_features(df, "id", "v"), 8, 2, block).collect()}
    want = clustering.hdbscan_labels(x, 8, 2)
    assert {(got[i], int(w)) for i, w in enumerate(want)} == {(got[i], int(want[i])) for i in got} and len({*got.values()}) == len({(got[i], int(w)) for i, w in enumerate(want)}) == len({*want.tolist()})


def test_wide_sparse_rows_against_numpy(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    x = rng.random((60, 400)) * (rng.random((60, 400)) < 0.05)
    rows = [(i, Vectors.sparse(400, np.flatnonzero(r).tolist(), r[r != 0].tolist()) if i % 2 else Vectors.dense(r)) for i, r in enumerate(x)]
    f = spark.createDataFrame(rows, ["doc_id", "features"])
    for run, m in ((decomposition.pca, x - x.mean(axis=0)), (decomposition.lsa, x)):
        _, s, vt = np.linalg.svd(m, full_matrices=False)
        v = vt[:3].T * np.sign(vt[:3].T[np.abs(vt[:3]).argmax(axis=1), range(3)])
        got = np.array([list(r)[1:4] for r in run(f, k=3).scores.orderBy("doc_id").collect()], float)
        assert np.allclose(got, m @ v, atol=1e-6)


def test_rounds_are_those_asked_for(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for method, rounds in (("nmf", 65), ("corex", 45)):
        model = topics.TopicModel(df, "id", "text", method, 2, max_ngram_size=1).fit(max_iter=rounds, tol=-1.0)
        assert model.rounds == rounds


def test_pca_and_lsa_against_numpy(blobs):
    x, df = blobs
    f = clustering.array_features(df, "id", "v")
    for name, run, m in (("pca", decomposition.pca, x - x.mean(axis=0)), ("lsa", decomposition.lsa, x)):
        d = run(f, ["a", "b", "c"], 2)
        _, s, vt = np.linalg.svd(m, full_matrices=False)
        v = vt[:2].T
        v = v * np.sign(v[np.abs(v).argmax(axis=0), [0, 1]])
        rows = d.scores.orderBy("doc_id").collect()
        assert np.allclose([[r[f"{name}_0"], r[f"{name}_1"]] for r in rows], m @ v, atol=1e-6)
        assert d.explained == pytest.approx(((m @ v).var(axis=0, ddof=1) / x.var(axis=0, ddof=1).sum()).tolist())
        assert decomposition.top_documents(d.scores, name, 2).count() <= 4
        assert decomposition.top_features(d, 1).count() == 2


def test_correspondence_analysis(spark):
    m = np.array([[10, 2, 1], [1, 8, 3], [0, 3, 9], [5, 5, 5.0]])
    edges = spark.createDataFrame([(f"r{i}", f"c{j}", float(m[i, j])) for i in range(4) for j in range(3)], "src string, dst string, w double")
    got = decomposition.correspondence_analysis(edges, 2).collect()
    p = m / m.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    inertia = (((p - np.outer(r, c)) ** 2) / np.outer(r, c)).sum()
    mass = dict(zip(["r0", "r1", "r2", "r3"], r))
    assert sum(mass[g.node] * (g.mca_1**2 + g.mca_2**2) for g in got) == pytest.approx(inertia)
    assert [g.mca_1 for g in got] == sorted([g.mca_1 for g in got], reverse=True)
    u, sv, _ = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)))
    want = u[:, :2] * sv[:2] / np.sqrt(r)[:, None]
    for g in got:
        assert np.allclose(np.abs([g.mca_1, g.mca_2]), np.abs(want[int(g.node[1])]), atol=1e-8)
    assert decomposition.correspondence_analysis(edges.limit(0), 2).columns == ["node", "mca_1", "mca_2"]


TEXTS = ["cats purr and kittens purr loudly", "dogs bark and puppies bark loudly"] * 30


@pytest.mark.parametrize("method, params", [("lda", {"max_iter": 30, "learning_offset": 10.0}), ("lda_auto", {"passes": 3}), ("nmf", {"max_iter": 30}), ("hdp", {"T": 6, "max_iter": 10}), ("corex", {"max_iter": 20, "anchors": ["cats", "dogs"]})])
def test_topics(spark, method, params):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "id long, text string")
    model = topics.TopicModel(df, "id", "text", method, None if method == "hdp" else 2, max_ngram_size=1, stop_words=["and"])
    assert model.get_score() is None
    model.fit(**params)
    docs = model.document_topics(df)
    assert docs.select("doc_id").distinct().count() == 60 and docs.select("topic").distinct().count() == model.k
    top = model.topics(3).collect()
    assert {t.rank for t in top} <= {1, 2, 3} and all(t.weight > 0 for t in top)
    score = model.get_score()
    assert set(score) == {"lda": {"perplexity", "score"}, "lda_auto": {"perplexity", "score"}, "hdp": {"perplexity", "score"}, "nmf": set(), "corex": {"total_correlation"}}[method]
    if method in ("nmf", "corex"):
        best = {r.doc_id: r.topic for r in docs.withColumn("k", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("doc_id").orderBy(F.desc("weight"), "topic"))).filter("k = 1").collect()}
        assert len({best[i] for i in range(0, 60, 2)}) == 1 and len({best[i] for i in range(1, 60, 2)}) == 1 and best[0] != best[1]


def test_topic_arguments(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for args in (("hdp", 3), ("lda", None), ("other", 2)):
        with pytest.raises(ValueError):
            topics.TopicModel(df, "id", "text", *args)
    with pytest.raises(ValueError):
        topics.fit_params("lda", nonsense=1)


def test_hdp_is_fitted_over_all_texts(spark):
    """Each pass takes every text: the parts that a corpus might be followed in don't matter, and planted topics are found."""
    import numpy as np

    from textloom.operators import topics

    rng = np.random.default_rng(0)
    texts = [(i, " ".join(f"t{i % 3}word{w}" for w in rng.integers(0, 8, 30))) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    one = topics.TopicModel(df, "doc_id", "text", "hdp", max_ngram_size=1, stop_words=[])
    first = one.fit(T=6, chunksize=1).fitted.topics
    assert np.allclose(first, one.fit(T=6, chunksize=256).fitted.topics, rtol=1e-4, atol=1e-6) and one.rounds == 20
    groups = np.array([[sum(w for w, v in zip(row, one.vocabulary) if v[1] == g) for g in "012"] for row in one.fitted.topics])
    assert set(groups[groups.max(axis=1) > 0.99].argmax(axis=1)) == {0, 1, 2}
    weights = one.document_topics(df).groupBy("doc_id").agg({"weight": "sum"}).collect()
    assert len(weights) == 120 and one.get_score()["perplexity"] < 15

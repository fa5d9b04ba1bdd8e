import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import common
from textloom.llm import langid


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 0")
    return langid.fit_text_model(docs, "doc_id", "text", "lang")


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 1")
    out = langid.identify(docs, model, host=F.col("source")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert np.mean([r.lang_id == r.lang for r in out]) > 0.98
    assert np.mean([r.rejected for r in out]) < 0.01


def test_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = langid.identify_pages(pages, model).collect()
    truth = {r.page_id: r.l for r in pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("l")).collect()}
    assert len(out) == len(truth) and np.mean([truth[r.page_id] == r.lang_id for r in out]) > 0.98


def test_trigrams_by_definition():
    texts = ["Ab, c", "", "éa", None, "12"]
    bucket, row = langid.trigrams(pa.array(texts))
    want = []
    for i, t in enumerate(texts):
        s = " " + "".join(c if c.isalpha() else " " for c in (t or "").lower()) + " "
        b = b" ".join(x for x in s.encode().split(b" ") if x)
        b = b" " + b + b" " if b else b" "
        want += [(i, ((b[j] << 16 | b[j + 1] << 8 | b[j + 2]) * 0x9E3779B1 % 2**32) >> 16) for j in range(len(b) - 2)]
    assert list(zip(row.tolist(), bucket.tolist())) == want


def _view(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, host string, markup string, suffix string")


def _by_hand(model, rows):
    """The posterior of each row, straight from the formula."""
    langs = model.languages
    logs, n = model.score(pa.array([r[1] for r in rows]))
    logs = logs * langid.TEMPER
    own = np.exp(logs - logs.max(axis=1, keepdims=True))
    own /= own.sum(axis=1, keepdims=True)
    ok = n > 0
    total = own[ok].sum(axis=0)
    broad = (total + 1) / (total.sum() + len(langs))
    domain_of = lambda h: ".".join(h.split(".")[-2:])
    hosts, domains = {}, {}
    for r, o, k in zip(rows, own, ok):
        if k and r[2] is not None:
            hosts[r[2]] = hosts.get(r[2], 0) + o
    for h, v in hosts.items():
        domains[domain_of(h)] = domains.get(domain_of(h), 0) + v
    out = []
    for r, log in zip(rows, logs):
        prior = broad
        if r[2] in hosts:
            d, h = domains[domain_of(r[2])], hosts[r[2]]
            q = (d + langid.DOMAIN_WEIGHT * broad) / (d.sum() + langid.DOMAIN_WEIGHT)
            prior = (h + langid.HOST_WEIGHT * q) / (h.sum() + langid.HOST_WEIGHT)
        z = np.log(prior) + log
        for says, truth in ((r[3], langid.MARKUP_TRUTH), (langid.SUFFIXES.get(r[4] or ""), langid.SUFFIX_TRUTH)):
            if says in langs:
                z = z + np.log(np.where(np.array(langs) == says, truth, (1 - truth) / (len(langs) - 1)))
        w = np.exp(z - z.max())
        out.append((langs[int(w.argmax())], w.max() / w.sum()))
    return out


def test_fusion_against_brute_force(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(40).collect()
    hosts = ["a.x.org", "b.x.org", "y.de", None, "solo"]
    rows = [(d.doc_id, d.text[:25], hosts[i % 5], [None, "de", "fr", "xx"][i % 4], [None, "de", "fr", "org"][i % 3]) for i, d in enumerate(docs)]
    rows += [(900, None, "a.x.org", "fr", "fr"), (901, "", None, None, "de"), (902, "...", "unheard.of", "es", None)]
    got = {r.doc_id: r for r in langid.identify(_view(spark, rows), model, host=F.col("host"), markup=F.col("markup"), suffix=F.col("suffix")).collect()}
    for r, (lang, p) in zip(rows, _by_hand(model, rows)):
        assert got[r[0]].lang_id == lang and got[r[0]].posterior == pytest.approx(p, abs=2e-6)
    assert got[900].lang_id == "fr" and got[901].lang_id == "de"


def test_noise_is_rejected(spark, model):
    rng = np.random.default_rng(0)
    noise = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 400)))
    out = langid.identify(spark.createDataFrame([(1, noise)], "doc_id long, text string"), model).first()
    assert out.rejected


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, model, extra):
    docs = common.odd_docs(spark, extra)
    out = langid.identify(docs, model, host=F.col("source")).collect()
    assert len(out) == 11 and all(r.rejected in (True, False) for r in out)
    by = {r.doc_id: r for r in out if r.doc_id}
    assert by[3].text_lang is None and by[2].text_lang is None
    alone = langid.identify(docs, model).collect()
    assert {r.doc_id: (r.rejected, r.lang_id) for r in alone if r.doc_id in (2, 3, 4, 7)} == {k: (True, None) for k in (2, 3, 4, 7)}
    kept = langid.drop_rejected(docs)
    assert kept.columns == docs.columns and kept.count() <= 11
    empty = common.empty_docs(spark)
    assert langid.identify(empty, model).count() == 0 and langid.drop_rejected(empty).count() == 0
    nobody = langid.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nobody) == 11 and all(r.rejected and r.lang_id is None for r in nobody)

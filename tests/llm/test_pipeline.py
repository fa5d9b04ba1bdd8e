import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import common
from tests.llm.test_decontaminate import brute as holds
from tests.llm.test_linededup import brute_whole, spark_hashes
from textloom.llm import bpe, langid, queries, simhash


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "bpe_encoding"]
    assert "pipeline" in queries.QUERIES and sum(n.startswith("op") for n in queries.QUERIES) == 10


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(16).collect()
    items = [r for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(5).collect()]
    rows = [(r.doc_id, r.text[:700], r.lang, r.source, len(r.text[:700])) for r in docs]
    base = rows[7]
    words = base[1].split()
    rows.append((10_001, base[1], base[2], base[3], base[4]))
    rows.append((10_002, " ".join(w if rng.random() > 0.03 else "zzz" for w in words), base[2], base[3], base[4]))
    rows.append((10_003, f"{rows[3][1][:300]} {items[0].text} {rows[3][1][300:]}", rows[3][2], rows[3][3], 9))
    rows += [(10_004, None, None, None, None), (10_005, "", "en", None, 0), (None, rows[5][1], "en", "src1", 5)]
    path = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(rows, common.DOCS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r.item_id, r.text) for r in items], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder)
        if name != "bpe_encoding":
            assert docs.columns == names
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            want = [r for r in before if not any(holds(r.text, t) for t in items)]
            assert sorted([r.doc_id for r in rows], key=str) == sorted([r.doc_id for r in want], key=str)
            assert 10_003 not in {r.doc_id for r in rows}
        if name == "near_duplicates":
            assert len(rows) <= len(before)
    codec = bpe.Codec(bpe.read_ranks(bpe.VOCABULARY))
    left = {r.doc_id: r.text for r in before}
    assert all(codec.decode(r.token_ids).decode() == left[r.doc_id] for r in rows if r.doc_id and r.token_ids is not None)
    assert common.rows(corpus_pipeline.run(spark, folder)) == common.rows(docs)


def test_copies_go_where_only_near_duplicates_are_judged(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in _stage("near_duplicates")(spark, docs, folder).collect()}
    base = docs.orderBy("doc_id").collect()
    original = min(r.doc_id for r in base if r.doc_id is not None and r.text == next(x.text for x in base if x.doc_id == 10_001))
    assert original in kept and not {10_001, 10_002} & kept


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, folder, name):
    for docs in (common.odd_docs(spark), common.odd_docs(spark, extra=True), common.empty_docs(spark)):
        out = _stage(name)(spark, docs, folder)
        assert name == "bpe_encoding" or out.columns == docs.columns
        out.collect()


def test_copies_that_line_dedup_emptied_go(spark, folder):
    text = " ".join(f"{common.sentence(k, 11)}." for k in range(6))
    rows = [(i, text, "en", "src0", len(text)) for i in range(1, 6)] + [(9, "!!", "en", "src0", 2), (None, "", "en", "src0", 0), (10, None, "en", "src0", None)]
    docs = _stage("line_dedup")(spark, spark.createDataFrame(rows, common.DOCS), folder)
    assert sorted(r.doc_id for r in docs.collect() if r.text == "" and r.doc_id) == [2, 3, 4, 5]
    left = sorted([(r.doc_id, r.text) for r in _stage("near_duplicates")(spark, docs, folder).collect()], key=str)
    assert left == sorted([(1, text), (2, ""), (9, "!!"), (None, ""), (10, None)], key=str)


def _near_brute(now, before):
    """Ids that stay when one of each group of texts within the limit stays, by all pairs of fingerprints."""
    nodes = [(i, t) for i, t in [*now, *[x for x in before if x[0] in {i for i, _ in now}]] if i is not None and t]
    f, some = simhash.fingerprints(pa.array([t for _, t in nodes]))
    top = {i: i for i, _ in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if some[a] and some[b] and np.bitwise_count(f[a] ^ f[b]).sum() <= simhash.MAX_DISTANCE:
                x, y = find(nodes[a][0]), find(nodes[b][0])
                top[max(x, y)] = min(x, y)
    first: dict = {}
    for i, t in sorted((i, t) for i, t in now if i is not None and t is not None and not any(c.isalnum() for c in t)):
        first.setdefault(t, i)
    return {i for i, t in now if i is None or (i not in top or find(i) == i) and first.get(t, i) == i}


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Documents of which some are near copies that differ in a few lines, so that line dedup leaves only these of them."""
    rng, rows = random.Random(6), []
    for base in range(8):
        lines = [f"{common.sentence(base * 40 + k, 11)}." for k in range(14)]
        for copy in range(3):
            mine = list(lines)
            for k in rng.sample(range(14), copy):
                mine[k] = mine[k].replace(".", f" changed{base}x{copy}.")
            rows.append((len(rows), " ".join(mine)))
    rows += [(90, " ".join(f"{common.sentence(900 + k, 9)}." for k in range(6))), (None, rows[0][1]), (91, None), (92, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], common.DOCS).coalesce(1)
    path = tmp_path_factory.mktemp("copies")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_line_dedup_and_near_duplicates_against_brute_force(spark, copies):
    folder, rows = copies
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cut = _stage("line_dedup")(spark, docs, folder)
    now = [(r.doc_id, r.text) for r in cut.collect()]
    assert sorted([t for _, t in now], key=str) == sorted(brute_whole(rows, spark_hashes(docs)), key=str)
    assert sum(len(t or "") for _, t in now) < 0.6 * sum(len(t or "") for _, t in rows)
    kept = [r.doc_id for r in _stage("near_duplicates")(spark, cut, folder).collect()]
    want = _near_brute(now, rows)
    assert set(kept) == want and len(kept) == len(want)
    # every near copy that the whole texts show is gone, though only changed lines were left of it
    lost = {r.doc_id for r in simhash.near_duplicate_groups(docs).filter("not kept").collect()}
    assert len(lost) == 16 and not lost & set(kept)


def test_language_stage_drops_what_is_rejected(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bad = {r.doc_id for r in langid.identify_documents(docs).filter("rejected").collect()}
    assert sorted([r.doc_id for r in _stage("language_id")(spark, docs, folder).collect()], key=str) == sorted([r.doc_id for r in docs.collect() if r.doc_id not in bad], key=str)
    assert 10_004 in bad or 10_004 not in {r.doc_id for r in _stage("language_id")(spark, docs, folder).collect()}


def test_columns_of_any_name(spark, folder):
    docs = common.odd_docs(spark)
    more = ["i", "h", "__doc", "__hash", "__bad", "c0", "c1", "loser", "cuts", "id", "text_hash", "node", "part"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, docs, folder)
        out = stage(spark, docs.selectExpr("*", *[f"7 as `{x}`" for x in more]), folder)
        assert out.columns == docs.columns + more
        assert common.rows(out.select(docs.columns)) == common.rows(plain) and {tuple(r) for r in out.select(more).collect()} <= {(7,) * len(more)}


def test_no_near_copy_at_the_limit_stays(spark, folder, monkeypatch):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (700, 256), dtype=np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.choice(256, simhash.MAX_DISTANCE, replace=False)] ^= 1
    words = np.packbits(np.concatenate([bits, other]), axis=1).view(np.int64)
    prints = spark.createDataFrame([(20_000 + i, *map(int, w)) for i, w in enumerate(words)], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    monkeypatch.setattr(simhash, "fingerprint_table", lambda *_: prints)
    docs = spark.createDataFrame([(20_000 + i, f"text {i}", "en", "src0", 9) for i in range(1400)], common.DOCS)
    assert sorted(r.doc_id for r in _stage("near_duplicates")(spark, docs, folder).collect()) == list(range(20_000, 20_700))

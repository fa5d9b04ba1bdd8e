import glob
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import common
from textloom import runtime
from textloom.llm import simhash


def _brute_fingerprint(text):
    """The fingerprint by its definition, one word after another."""
    import re

    from textloom.llm import arrays as A

    words = {w for w in re.findall(rb"[0-9A-Za-z_\x80-\xff]+", text.lower().encode())}
    count = [0] * 256
    for w in words:
        data = np.frombuffer(w, np.uint8)
        h = A.span_hashes(data, np.array([0]), np.array([len(data)]))
        bits = np.concatenate([np.unpackbits(A.mix(h + s).view(np.uint8), bitorder="little") for s in simhash._SEEDS])
        count = [c + int(b) for c, b in zip(count, bits)]
    return [2 * c > len(words) for c in count], bool(words)


def test_fingerprints_match_definition():
    texts = ["", "One two, two three.", "ÄÖ äö x", common.sentence(4, 200), "###", "a b", None]
    words, some = simhash.fingerprints(pa.array(texts))
    for i, t in enumerate(texts):
        bits, any_word = _brute_fingerprint(t or "")
        assert some[i] == any_word
        assert np.unpackbits(words[i].view(np.uint8), bitorder="little").astype(bool).tolist() == bits


def test_many_words_do_not_overflow():
    text = " ".join(f"w{i}" for i in range(120_000))
    words, _ = simhash.fingerprints(pa.array([text]))
    parts = simhash._WORDS_AT_ONCE
    simhash._WORDS_AT_ONCE = 7_000
    try:
        again, _ = simhash.fingerprints(pa.array([text]))
    finally:
        simhash._WORDS_AT_ONCE = parts
    assert (words == again).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.integers(0, 2**32 - 1))
def test_pigeonring_loses_no_pair_within_the_limit(flips, seed):
    rng = np.random.default_rng(seed)
    diff = np.zeros(256, np.uint8)
    diff[rng.choice(256, flips, replace=False)] = 1
    words = np.packbits(diff).view(np.uint64).reshape(1, 4)
    if flips <= simhash.MAX_DISTANCE:
        assert simhash.pigeonring(words)[0]
        assert simhash.within(np.concatenate([words, words * 0]), np.array([0]), np.array([1]))[0]
    else:
        assert not simhash.within(np.concatenate([words, words * 0]), np.array([0]), np.array([1]))[0]


def _noisy(words, rng, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    docs, k = [], 0
    for base in range(60):
        words = [f"{rng.choice(common.WORDS)}{rng.randrange(400)}" for _ in range(rng.randrange(60, 300))]
        for copy in range(rng.choice([1, 1, 2, 3, 9])):
            docs.append((k, " ".join(_noisy(words, rng, rng.choice([0, 0.02, 0.05, 0.08]) if copy else 0))))
            k += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    f, _ = simhash.fingerprints(pa.array([t for _, t in docs]))
    a, b = np.triu_indices(len(docs), 1)
    near = np.bitwise_count(f[a] ^ f[b]).sum(axis=1) <= simhash.MAX_DISTANCE
    label = simhash._stars(len(docs), a[near], b[near])
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(df).collect()}
    true = {(i, j) for i, j in zip(a[near].tolist(), b[near].tolist())}
    found = {p for p in true if p[0] in got and got[p[0]] == got.get(p[1])}
    assert len(true) > 100 and len(found) >= 0.9 * len(true)
    assert found == true
    assert all(label[d] == label[g] for d, g in got.items())
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {i for i, _ in docs} - {d for d, g in got.items() if d != g}


def test_hot_group_of_copies(spark):
    text = common.sentence(9, 80)
    df = spark.createDataFrame([(i, text + (f" x{i}" if i % 3 else "")) for i in range(900)], "doc_id long, text string")
    got = simhash.near_duplicate_groups(df).collect()
    assert len(got) == 900 and {r.group_id for r in got} == {0} and sum(r.kept for r in got) == 1 and got[0].group_size == 900


def test_odd_rows(spark):
    for extra in (False, True):
        docs = common.odd_docs(spark, extra)
        assert simhash.near_duplicate_groups(docs).count() == 0
        kept = simhash.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted([r.doc_id for r in kept.select("doc_id").collect()], key=str) == sorted([1, 2, None, None, 3, 4, 5, 6, 7, 8], key=str)
    empty = common.empty_docs(spark)
    assert simhash.near_duplicate_groups(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def _pairs_at(rng, n, distance):
    """Words of n random fingerprints, and of n others that differ from them in so many bits."""
    base = rng.integers(0, 2, (n, 256), dtype=np.uint8)
    other = base.copy()
    for row in other:
        row[rng.choice(256, distance, replace=False)] ^= 1
    return [np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in (base, other)]


def test_every_pair_is_found_at_every_distance_up_to_the_limit():
    rng = np.random.default_rng(1)
    for n, distances in ((300, (1, 20, 34, 40, 43, 44)), (6000, (44,))):
        for distance in distances:
            both = np.concatenate(_pairs_at(rng, n, distance))
            for first in (n, 2 * n):
                x, y = simhash._links(both, first)
                assert sorted(zip(y.tolist(), x.tolist())) == [(i, n + i) for i in range(n)]
    assert len(simhash._links(np.concatenate(_pairs_at(rng, 300, 45)), 600)[0]) == 0


def test_chunks_leave_no_way_around_them():
    for n in (1, 1000, 10**5, 10**6):
        for most in (0, 3, 44, 60):
            plan = simhash.chunk_plan(n, most)
            assert sum(bits for _, bits, _ in plan) == 256 and sum(radius + 1 for *_, radius in plan) == most + 1


def test_no_pair_at_the_limit_is_lost(spark, monkeypatch):
    base, other = _pairs_at(np.random.default_rng(7), 700, simhash.MAX_DISTANCE)
    rows = [(i, *map(int, w.view(np.int64))) for i, w in enumerate(np.concatenate([base, other]))]
    prints = spark.createDataFrame(rows, "doc_id long, f0 long, f1 long, f2 long, f3 long")
    monkeypatch.setattr(simhash, "fingerprint_table", lambda *_: prints)
    docs = spark.createDataFrame([], "doc_id long, text string")
    for small in (simhash.SMALL_BLOCK, 150):
        monkeypatch.setattr(simhash, "SMALL_BLOCK", small)
        got = {(r.group_id, r.doc_id) for r in simhash.near_duplicate_groups(docs).collect() if not r.kept}
        assert got == {(i, 700 + i) for i in range(700)}


def test_a_crowd_is_linked_as_all_pairs_link_it():
    rng = np.random.default_rng(4)
    bits = np.repeat(rng.integers(0, 2, (6, 256), dtype=np.uint8), 60, axis=0)
    bits ^= rng.random(bits.shape) < 0.07
    bits[100:140] = bits[100] ^ (np.arange(256) < np.arange(40)[:, None] * 6)  # a chain: its ends are far apart
    words = np.packbits(bits, axis=1).view(np.uint64)
    a, b = np.triu_indices(len(words), 1)
    ok = simhash.within(words, a, b)
    want = simhash._stars(len(words), a[ok], b[ok])
    assert (simhash._reach(words, simhash.MAX_DISTANCE) == want).all() and 1 < len(set(want.tolist())) < 200
    x, y = simhash._links(words, len(words))
    assert (simhash._stars(len(words), x, y) == want).all()
    cross = (a < 150) & (b >= 150) & ok
    x, y = simhash._links(words, 150)
    got = simhash._stars(len(words), x, y)
    assert (got[a[cross]] == got[b[cross]]).all() and (want[x] == want[y]).all()


def test_texts_of_earlier_are_compared_too(spark):
    text = common.sentence(3, 120)
    before = spark.createDataFrame([(i, f"{text} mark{i}") for i in range(5)] + [(9, common.sentence(8, 90))], "doc_id long, text string")
    now = spark.createDataFrame([(0, f"{text} mark0")] + [(i, f"mark{i}") for i in range(1, 5)] + [(9, common.sentence(8, 90)), (10, "mark3")], "doc_id long, text string")
    assert simhash.near_duplicate_groups(now).count() == 2
    kept = {r.doc_id for r in simhash.drop_near_duplicates(now, originals=before).collect()}
    assert kept == {0, 9}  # 10 is a copy of 3 as it is now, and 3 was one of 0


def test_repeated_ids_and_clashing_names(spark):
    text = common.sentence(9, 80)
    rows = [(1, text, "x"), (1, "b other words here", "x"), (1, "b other words here", "x"), (2, text, "y"), (None, "n", "z"), (None, "n", "z")]
    names = ["doc_id", "text", "nth"]
    more = ("__nth_of_id", "loser", "again", "c0", "component", "f0", "node")
    df = spark.createDataFrame(rows, "doc_id long, text string, nth string").withColumns({x: F.lit(7) for x in more})
    out = simhash.drop_near_duplicates(df, wordless=True)
    assert out.columns == [*names, *more]
    assert sorted([(r.doc_id, r.text, r.c0) for r in out.collect()], key=repr) == sorted([(1, min(text, "b other words here"), 7), (None, "n", 7), (None, "n", 7)], key=repr)


def _graph(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(1, 1), (7, 3), (7, 3)]
    return spark.createDataFrame(edges, "a long, b long").repartition(5)


def test_links_are_connected_in_one_task_as_by_rounds(spark, monkeypatch):
    at_once = common.rows(simhash._components(_graph(spark)))
    assert (7, 3) in at_once and (400, 100) in at_once and all(node != 1 for node, _ in at_once)
    assert simhash._components(_graph(spark).limit(0)).count() == 0
    monkeypatch.setattr(simhash, "LINKS_AT_ONCE", 0)
    assert common.rows(simhash._components(_graph(spark))) == at_once


def test_few_files_are_written(spark):
    texts = [common.sentence(i // 2, 60) + f" x{i}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    mark = runtime.written_so_far()
    assert simhash.near_duplicate_groups(docs).count() > 100
    assert sum(len(glob.glob(f"{path.removeprefix('file://')}/part-*")) for path in runtime._WRITTEN[mark:]) <= 12

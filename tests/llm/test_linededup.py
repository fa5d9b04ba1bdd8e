import random

import pytest

from tests.llm import common
from textloom.llm import arrays as A
from textloom.llm import linededup

import numpy as np
from pyspark.sql import functions as F


def split(text):
    """Lines by their definition: (start, end) of the bytes."""
    raw, out, begin = text.encode(), [], 0
    for i in range(len(raw)):
        last = i + 1 == len(raw)
        if raw[i] == 10 or (raw[i : i + 1] in (b".", b"!", b"?") and (last or raw[i + 1] in b" \t\n\r\x0b\x0c")) or last:
            part = raw[begin : i + 1]
            bare = part.strip(b" \t\n\r\x0b\x0c")
            if bare:
                start = begin + part.index(bare)
                out.append((start, start + len(bare)))
            begin = i + 1
    return raw, out


def h(b):
    d = np.frombuffer(b, np.uint8)
    return int(A.span_hashes(d, np.array([0]), np.array([len(d)]))[0])


def brute(docs, hashes):
    """docs: (id, text) in row order, Spark's hash of each text; the texts left."""
    found = []
    for row, (key, text) in enumerate(docs):
        raw, spans = split(text or "")
        before, open_ = 0, []
        for k, (a, b) in enumerate(spans):
            now = h(raw[a:b])
            open_.append((a, b))
            rolled = int(A.mix(np.array([(now * 3 + before * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            before = now
            if rolled % linededup.DIVISOR == 0 or k + 1 == len(spans):
                found.append((key is None, key or 0, row, len([1 for x in found if x[2] == row]), open_[0][0], open_[-1][1], len(open_), raw))
                open_ = []
    owner, gone = {}, {}
    text_hash = {t: int(k) for t, k in hashes.items()}
    for null, key, row, _, a, b, n, raw in sorted(found, key=lambda x: (not x[0], x[1], text_hash[x[7].decode()], x[4])):
        if n >= linededup.MIN_LINES and b - a >= linededup.MIN_BYTES:
            me = (null, key, raw, a)
            if owner.setdefault(raw[a:b], me) != me:
                nexts = sorted(x[4] for x in found if x[2] == row and x[4] >= b)
                gone.setdefault(row, []).append((a, nexts[0] if nexts else len(raw)))
    out = []
    for row, (_, text) in enumerate(docs):
        if text is None:
            out.append(None)
            continue
        raw = text.encode()
        for a, b in sorted(gone.get(row, []), reverse=True):
            raw = raw[:a] + raw[b:]
        out.append(raw.decode())
    return out


def spark_hashes(df):
    from pyspark.sql import functions as F

    return {r[0]: r[1] for r in df.filter("text is not null").select("text", F.xxhash64("text")).collect()}


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"{common.sentence(i, rng.randrange(3, 12))}{rng.choice('.!?')}" for i in range(40)]
    passages = [" ".join(rng.sample(pool, 8)) for _ in range(5)]
    docs = []
    for i in range(120):
        parts = [f"own {common.sentence(100 + i * 7 + k, 6)}." for k in range(rng.randrange(0, 8))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        docs.append((i if i % 17 else None, rng.choice(["\n", " ", "\n\n"]).join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    order = [(r.doc_id, r.text) for r in df.collect()]
    got = [r.text for r in linededup.dedup_lines(df).collect()]
    want = brute(order, spark_hashes(df))
    assert sorted(got) == sorted(want)
    assert sum(map(len, want)) < 0.8 * sum(len(t) for _, t in docs)


def test_full_bitmap_changes_nothing(spark):
    passage = " ".join(f"{common.sentence(k, 9)}." for k in range(12))
    docs = spark.createDataFrame([(i, f"{common.sentence(50 + i)}. {passage}") for i in range(20)], "doc_id long, text string")
    want = common.rows(linededup.dedup_lines(docs))
    bits, linededup.BITMAP_BITS = linededup.BITMAP_BITS, 7
    try:
        assert common.rows(linededup.dedup_lines(docs)) == want
    finally:
        linededup.BITMAP_BITS = bits


def test_shifted_passage_is_caught(spark):
    passage = " ".join(f"{common.sentence(k, 9)}." for k in range(12))
    docs = [(1, f"Begin one. {passage} End one."), (2, f"Other start here. And more.\n{passage}\nTail.")]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), report=True).collect()}
    assert got[1].removed_chunks == 0 and got[1].text == docs[0][1]
    assert len(got[2].text) < 0.5 * len(docs[1][1]) and got[2].text.startswith("Other start here.")


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    docs = common.odd_docs(spark, extra).coalesce(1)
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], spark_hashes(docs))
    assert sorted([r.text for r in out.select("text").collect()], key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.select("text", "n_chars").collect())
    assert linededup.dedup_lines(common.empty_docs(spark)).count() == 0


def brute_whole(docs, hashes):
    """The texts left when each line goes that is in a run that also stands at an earlier place."""
    spots, spans = [], {}
    for row, (key, text) in enumerate(docs):
        raw, spans[row] = split(text or "")
        spots += [((key is not None, key or 0, hashes.get(text, 0), k), row, k, raw[a:b]) for k, (a, b) in enumerate(spans[row])]
    line = {(row, k): s for _, row, k, s in spots}
    gone = set()
    for place, row, k, s in spots:
        for other, r, m, t in spots:
            if s == t and other < place:
                n = 0
                while (row, k + n) in line and line[row, k + n] == line.get((r, m + n)):
                    n += 1
                run = [line[row, k + i] for i in range(n)]
                if n >= 2 and len(b" ".join(run)) >= 60 or any(len(x.split()) > 50 for x in run):
                    gone.update((row, k + i) for i in range(n) if n >= 2 and len(b" ".join(run)) >= 60 or len(run[i].split()) > 50)
    out = []
    for row, (_, text) in enumerate(docs):
        raw = (text or "").encode()
        for k in reversed(range(len(spans[row]))):
            if (row, k) in gone:
                raw = raw[: spans[row][k][0]] + (raw[spans[row][k + 1][0] :] if k + 1 < len(spans[row]) else b"")
        out.append(None if text is None else raw.decode())
    return out


def test_whole_runs_against_brute_force(spark):
    rng = random.Random(5)
    pool = [f"{common.sentence(i, rng.choice([1, 2, 4, 9, 60]))}{rng.choice('.!?')}" for i in range(30)]
    docs = []
    for i in range(50):
        parts = [f"own {common.sentence(100 + i * 7 + k, 6)}." for k in range(rng.randrange(0, 5))]
        at = rng.randrange(len(pool) - 6)
        parts[1:1] = pool[at : at + rng.randrange(0, 7)]
        docs.append((i if i % 17 else None, rng.choice(["\n", " ", "\n\n"]).join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    order = [(r.doc_id, r.text) for r in df.collect()]
    got = [r.text for r in linededup.dedup_lines(df, whole=True).collect()]
    assert sorted(got) == sorted(brute_whole(order, spark_hashes(df)))


def test_whole_passages_of_any_length_go(spark):
    """Recall by length: all lines of passages of 2 to 10 lines, whatever stands around them; of one line, if it is long."""
    docs, want = [], {}
    for n in range(1, 11):
        for k in range(20):
            passage = [f"p{n}k{k} {common.sentence(n * 20 + k + i, 11)}." for i in range(n)]
            for copy in (0, 1):
                own = [f"own{n}k{k}c{copy} {common.sentence(copy + i, 9)} {copy}{i}." for i in range(2)]
                docs.append((len(docs), " ".join([own[0], *passage, own[1]])))
                want[docs[-1][0]] = docs[-1][1] if n == 1 or copy == 0 else " ".join(own)
    long = f"long {common.sentence(3, 51)}."
    docs += [(1000, f"Begin here. {long} Over."), (1001, f"Start there. {long} Done.")]
    want |= {1000: docs[-2][1], 1001: "Start there. Done."}
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), report=True, whole=True).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert {r.removed_chunks for r in out if r.text != dict(docs)[r.doc_id]} == {1}
    chunks = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(len(r.text) for r in chunks) > 1.2 * sum(map(len, want.values()))


@pytest.mark.parametrize("extra", [False, True])
def test_whole_odd_rows(spark, extra):
    docs = common.odd_docs(spark, extra).coalesce(1)
    out = linededup.dedup_lines(docs, whole=True)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert linededup.dedup_lines(common.empty_docs(spark), whole=True).count() == 0


@pytest.mark.parametrize("whole", [False, True])
def test_held_pieces_change_nothing_and_names_may_clash(spark, whole):
    rng = random.Random(11)
    pool = [f"{common.sentence(k, 9)}." for k in range(30)]
    docs = [(i if i % 9 else None, " ".join(rng.sample(pool, 3) + pool[(at := rng.randrange(20)) : at + 7])) for i in range(60)]
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").repartition(5)
    want = common.rows(linededup.dedup_lines(df, whole=whole))
    kept, linededup.HELD = linededup.HELD, 3
    try:
        assert common.rows(linededup.dedup_lines(df, whole=whole)) == want
    finally:
        linededup.HELD = kept
    more = ("__cuts", "__id", "__hash", "id", "hash", "cuts", "c0", "start", "text_hash")
    out = linededup.dedup_lines(df.withColumns({x: F.lit(7) for x in more}), whole=whole)
    assert out.columns == ["doc_id", "text", *more]
    assert common.rows(out.select("doc_id", "text")) == want and {tuple(r)[2:] for r in out.collect()} == {(7,) * len(more)}


def test_one_line_over_and_over(spark):
    """Two texts that share a line fifty times keep one such run."""
    line = "the same line of text again and again."
    rows = [(1, "\n".join([line] * 50)), (2, "own words first.\n" + "\n".join([line] * 50)), (3, line)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    assert len(got[1]) < 3 * len(line) and got[2] == "own words first.\n" and got[3] == line

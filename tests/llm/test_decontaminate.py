import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import common
from textloom.llm import decontaminate as D


def brute(text, item):
    """Whether any window of the item is within the edit budget of a stretch of the text, by whole alignments."""
    t, x = (bytes(D.letters(pa.array([v or ""]))[0]) for v in (text, item))
    w = min(len(x), D.WINDOW)
    if w < D.Q:
        return False
    e = int(w * D.EDIT_RATE)
    for s in range(len(x) - w + 1):
        cost = [0] * (len(t) + 1)
        for i, c in enumerate(x[s : s + w]):
            new = [i + 1] + [0] * len(t)
            for j in range(len(t)):
                new[j + 1] = min(cost[j] + (t[j] != c), cost[j + 1] + 1, new[j] + 1)
            cost = new
        if min(cost) <= e:
            return True
    return False


def _mutate(text, rng, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        rng.choice([lambda: t.__setitem__(i, rng.choice("abcxyz")), lambda: t.insert(i, rng.choice("abcxyz")), lambda: t.pop(i)])()
    return "".join(t)


def test_against_brute_force(spark):
    rng = random.Random(7)
    syllables = "th er on an re he in ed nd ha at en".split()
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(n))
    items = [(i, prose(rng.choice([3, 8, 14, 20]))) for i in range(8)] + [(8, "short"), (9, None), (10, "")]
    docs = []
    for k in range(60):
        item = items[rng.randrange(8)][1]
        a = rng.randrange(max(1, len(item) - 70))
        part = _mutate(item[a : a + rng.choice([45, 62, 75, 120])], rng, rng.choice([0, 1, 2, 3, 4, 5, 8, 12]))
        docs.append((k, f"{prose(rng.randrange(12))} {part} {prose(rng.randrange(12))}"))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in docs for i, x in items if brute(t, x)}
    assert len(want) > 15
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == want
    assert {r.doc_id for r in D.drop_contaminated(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    most, D.INDEX_LETTERS = D.INDEX_LETTERS, 40
    try:
        assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == want
    finally:
        D.INDEX_LETTERS = most


def test_banded_alignment():
    a, b = np.frombuffer(b"abcdefgh", np.uint8), np.frombuffer(b"xxabcdfghyy", np.uint8)
    assert D.window_edits(a, 0, 1, 8, b, 0, 4).tolist() == [1]
    assert D.window_edits(a, 0, 1, 8, b, -8, -4)[0] >= 4


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    docs = common.odd_docs(spark, extra)
    bench = spark.createDataFrame([(1, common.sentence(1)), (1, common.sentence(1)), (None, common.sentence(2)), (2, None), (3, ""), (4, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (None, None)}
    left = D.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 8
    assert D.contaminated(common.empty_docs(spark), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0


def test_periodic_texts_against_brute_force():
    """Repeated stretches, and pairs of places in parts, change nothing."""
    rng = random.Random(3)
    unit = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    items = [u * (90 // len(u)) for u in (unit(1), unit(2), unit(7))] + [(unit(3) * 10 + unit(12)) * 2]
    texts = [_mutate(t + t[:60], rng, n) for t in items for n in (0, 9, 60)]
    want = {(r, i) for r, t in enumerate(texts) for i, x in enumerate(items) if brute(t, x)}
    assert 5 < len(want) < 0.9 * len(texts) * len(items)
    index = D.Index(list(range(len(items))), items)
    kept = D._PAIRS_AT_ONCE, D.REPEATS
    for D._PAIRS_AT_ONCE, D.REPEATS in (kept, (50, 10**9), (50, 0), (kept[0], 10**9)):
        assert {(m[0], int(index.ids[m[1]])) for m in D.find(index, pa.array(texts))} == want
    D._PAIRS_AT_ONCE, D.REPEATS = kept


@pytest.mark.parametrize("unit", ["a", "ab", "the quick brown fox jumps over the lazy dog and runs away from the wolf. "])
def test_long_repetitive_texts_take_bounded_memory(unit):
    import time
    import tracemalloc

    text = unit * (1_000_000 // len(unit))
    tracemalloc.start()
    begun = time.monotonic()
    found = D.find(D.Index([1], [text]), pa.array([text, unit * 100, "nothing of it"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted({m[0] for m in found}) == [0, 1] and peak < 500e6 and time.monotonic() - begun < 60

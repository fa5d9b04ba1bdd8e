"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.runtime import materialise, require, sent_if_small

Q = 8
#: A match is a window of an item of this many letters and digits (the whole item if it is shorter) ...
WINDOW = 50
#: ... that is within this share of edits of a stretch of the document.
EDIT_RATE = 0.08
#: Bands of diagonals: each is BAND wide and reaches over into the next by the edit budget.
BAND = 8
#: Stretches of a text are the same for every match when they agree in so many letters; more than WINDOW and its edits.
STRETCH = 64
#: Places of a text that one q-gram may have before the text is gone through without its repeated stretches.
REPEATS = 16
#: Pairs of places of a text and an item that are held at once.
_PAIRS_AT_ONCE = 1_000_000
#: Benchmark letters whose q-grams go to the workers at once (16 bytes a letter); a larger benchmark takes several passes.
INDEX_LETTERS = 4_000_000
_TABLE_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits of all rows end to end, and the rows' offsets; all else is left out."""
    data, offs = A.text_bytes(pc.utf8_lower(arr))
    keep = A.WORD[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return data[keep], before[offs]


def qgrams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one word; the last seven places are left out."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    a = data.astype(np.uint64)
    two = a[:-1] | (a[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four[:-4] | (four[4:] << np.uint64(32))


def distinct_stretches(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and offsets of pieces of the rows that hold each different run of STRETCH letters of a row once, and their rows.

    A match looks at no more than STRETCH letters of either side, so the pieces match what the rows match; but a
    text of one line over and over is cut down to little more than the line.
    """
    parts, bounds, owner = [], [0], []
    for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        text = data[a:b]
        cuts = [(0, b - a)]
        if b - a > STRETCH:
            at = np.arange(b - a - STRETCH + 1)
            first = np.sort(np.unique(A.span_hashes(text, at, at + STRETCH), return_index=True)[1])
            gap = np.flatnonzero(np.diff(first) > 1)
            cuts = list(zip(first[np.r_[0, gap + 1]].tolist(), (first[np.r_[gap, len(first) - 1]] + STRETCH).tolist()))
        for x, y in cuts:
            parts.append(text[x:y])
            bounds.append(bounds[-1] + y - x)
            owner.append(r)
    return np.concatenate([np.zeros(0, np.uint8), *parts]), np.array(bounds, np.int64), np.array(owner, np.int64)


class Index:
    """q-grams of some benchmark items: sorted, with the item and place of each. An item may be several pieces."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offs, owner = distinct_stretches(*letters(pa.array(texts, pa.string())))
        self.ids, self.data, self.offs = np.array(ids, np.int64)[owner], data, offs
        grams = qgrams(data)
        item = np.searchsorted(offs, np.arange(len(grams)), side="right") - 1
        inside = np.arange(len(grams)) + Q <= offs[item + 1]
        grams, item, place = grams[inside], item[inside], np.flatnonzero(inside) - offs[item[inside]]
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.r_[first, len(order)]
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams * _MULTIPLIER) >> np.uint64(64 - _TABLE_BITS)] = True
        length = np.diff(offs)
        self.window = np.minimum(length, WINDOW)
        self.edits = (self.window * EDIT_RATE).astype(np.int64)
        #: q-gram lemma: a window of w letters within e edits keeps at least w + 1 - q (e + 1) of its q-grams.
        self.least = np.maximum(1, self.window + 1 - Q * (self.edits + 1))


def window_edits(whole: np.ndarray, first: int, count: int, w: int, text: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each of ``count`` windows whole[s : s + w] from s = first on, the least edits to any stretch of the text.

    Paths stay on the diagonals low to high; diagonal d pairs whole[i] with text[i + d]. All windows go through the
    letters of their patterns together.
    """
    width = high - low + 1
    far = np.int16(w + 1)
    step = np.arange(width, dtype=np.int16)
    padded = np.full(count + w + width, -1, np.int16)
    at = np.arange(len(padded)) + first + low
    inside = (at >= 0) & (at < len(text))
    padded[inside] = text[at[inside]]
    seen = np.lib.stride_tricks.sliding_window_view(padded, width)
    start = np.lib.stride_tricks.sliding_window_view(at, width)[:count]
    cost = np.where((start >= 0) & (start <= len(text)), np.int16(0), far)
    for i in range(w):
        new = cost + (seen[i : i + count] != whole[first + i : first + i + count, None])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum(np.minimum.accumulate(new - step, axis=1) + step, far)
    return cost.min(axis=1)


def _hits(index: Index, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose q-gram is in the index, their rows, and the q-grams' slots."""
    grams = qgrams(data)
    if len(grams) == 0 or len(index.grams) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    hit = np.flatnonzero(index.table[(grams * _MULTIPLIER) >> np.uint64(64 - _TABLE_BITS)])
    row = np.searchsorted(offs, hit, side="right") - 1
    inside = hit + Q <= offs[row + 1]
    hit, row = hit[inside], row[inside]
    slot = np.searchsorted(index.grams, grams[hit])
    slot[slot == len(index.grams)] = 0
    same = index.grams[slot] == grams[hit]
    return hit[same], row[same], slot[same]


def find(index: Index, arr: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of the matches; start and end count letters and digits of the row's text.

    Rows in which a q-gram of the index has more than REPEATS places are gone through by their different stretches,
    and places are counted in these.
    """
    data, offs = letters(arr)
    hit, row, slot = _hits(index, data, offs)
    if len(hit) == 0:
        return []
    pair, times = np.unique(row * len(index.grams) + slot, return_counts=True)
    again = np.unique(pair[times > REPEATS] // len(index.grams))
    if len(again) == 0:
        return _search(index, data, offs, hit, row, slot)
    calm = ~np.isin(row, again)
    out = _search(index, data, offs, hit[calm], row[calm], slot[calm])
    for r in again.tolist():
        text = data[offs[r] : offs[r + 1]]
        parts, bounds, _ = distinct_stretches(text, np.array([0, len(text)]))
        best: dict[int, tuple] = {}
        for _, t, begin, end, edits in _search(index, parts, bounds, *_hits(index, parts, bounds)):
            best[t] = max(best.get(t, (r, t, 0, 0, 0)), (r, t, begin, end, edits), key=lambda m: (m[3] - m[2], -m[4]))
        out += best.values()
    return out


def _qualify(index: Index, hit, row, slot, offs, own: int) -> tuple[np.ndarray, ...]:
    """(row, item, band, place, place of the last, diagonal) of those of the first ``own`` hits from which on enough lie in a window of a band."""
    count = index.first[slot + 1] - index.first[slot]
    post = np.repeat(index.first[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    mine = np.repeat(np.arange(len(hit)) < own, count)
    row, place = np.repeat(row, count), np.repeat(hit - offs[row], count)
    item = index.item[post].astype(np.int64)
    diagonal = place - index.place[post]
    band = diagonal // BAND
    over = np.flatnonzero(diagonal - band * BAND < index.edits[item])  # these also count for the band before
    band = np.r_[band, band[over] - 1]
    row, item, place, diagonal, mine = (np.r_[x, x[over]] for x in (row, item, place, diagonal, mine))
    order = np.lexsort((place, band, item, row))
    row, item, place, band, diagonal, mine = (x[order] for x in (row, item, place, band, diagonal, mine))
    last = np.arange(len(row)) + index.least[item] - 1
    ok = last < len(row)
    last = np.where(ok, last, 0)
    ok &= mine & (row[last] == row) & (item[last] == item) & (band[last] == band) & (place[last] - place <= index.window[item] + index.edits[item] - Q)
    ok = np.flatnonzero(ok)
    return row[ok], item[ok], band[ok], place[ok], place[last[ok]], diagonal[ok]


def _search(index: Index, data, offs, hit, row, slot) -> list[tuple[int, int, int, int, int]]:
    """``find`` for given hits, some hundred thousand pairs of places at once."""
    if len(hit) == 0:
        return []
    total = np.cumsum(index.first[slot + 1] - index.first[slot])
    reach = int((index.window + index.edits).max())
    parts, at = [], 0
    while at < len(hit):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + _PAIRS_AT_ONCE, side="right")))
        # places count through all rows, so the hits that windows reach are those up to a place
        upto = int(np.searchsorted(hit, hit[to - 1] + reach, side="right"))
        parts.append(_qualify(index, hit[at:upto], row[at:upto], slot[at:upto], offs, to - at))
        at = to
    row, item, band, place, until, diagonal = (np.concatenate(x) for x in zip(*parts))
    if len(row) == 0:
        return []
    order = np.lexsort((place, band, item, row))
    row, item, band, place, until, diagonal = (x[order] for x in (row, item, band, place, until, diagonal))
    key = np.stack([row, item, band])
    new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0) | (place[1:] > until[:-1] + WINDOW)]
    cut = np.flatnonzero(new)
    begin = place[cut]
    end = np.maximum.reduceat(until, cut) + Q
    found, done = [], set()
    for k in np.lexsort((begin, begin - end, item[cut], row[cut])).tolist():
        g = cut[k]
        r, t = int(row[g]), int(item[g])
        if (r, t) not in done:
            text, whole = data[offs[r] : offs[r + 1]], index.data[index.offs[t] : index.offs[t + 1]]
            edits = _verify(text, whole, int(index.window[t]), int(index.edits[t]), int(band[g]) * BAND, int(begin[k]), int(end[k]), int(diagonal[g]))
            if edits is not None:
                done.add((r, t))
                found.append((r, t, int(begin[k]), int(end[k]), edits))
    return found


def _verify(text: np.ndarray, whole: np.ndarray, w: int, e: int, low: int, begin: int, end: int, diagonal: int) -> int | None:
    """The edits of the first window of the item, from the likeliest on, that a stretch of the region is within e of."""
    high = low + BAND - 1 + e
    most = len(whole) - w
    likely = min(max(begin - diagonal, 0), most)
    if 0 <= likely + diagonal <= len(text) - w and (text[likely + diagonal : likely + diagonal + w] == whole[likely : likely + w]).all():
        return 0
    first = max(0, min(begin - high - w, most))
    edits = window_edits(whole, first, min(most, max(first, end - low)) + 1 - first, w, text, low - e, high + e)
    ok = np.flatnonzero(edits <= e)
    return int(edits[ok[np.abs(ok + first - likely).argmin()]]) if len(ok) else None


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, edits, text_hash): each document that holds a passage of a benchmark item.

    Texts are compared by their lower-case letters and digits. A document holds an item when some window of 50 of
    the item's letters (the whole of a shorter item) is within 4 edits (8 %) of a stretch of the document. Such a
    window shares at least 50 + 1 - 8 * 5 = 11 of its 8-grams with the stretch, on diagonals no further apart than
    the edits; bands of diagonals overlap by that much, so no match is missed. Regions with enough shared q-grams
    close together are verified by banded alignment. ``matched`` is the length of the longest such region in letters,
    ``edits`` those of its window first verified, ``text_hash`` is xxhash64 of the text.

    The q-gram index of the benchmark is broadcast up to INDEX_LETTERS letters; beyond that the benchmark is gone
    through in parts, one pass over the documents each, and the driver holds one part at a time. Null ids of
    documents are carried; null or empty texts and items, and items of fewer than 8 letters, match nothing. Very long
    texts are searched whole; repeated stretches of a text or an item count once, and pairs of places are held a
    million at a time, so that texts of one letter or line over and over take no more memory than others. Repeated
    items of one id are all searched and reported once, as are repeated documents of one id and text. Ties between
    items don't matter, as each is reported. Empty tables give no rows. Other columns are not read.
    """
    require(docs, id_col, text_col)
    require(benchmark, item_col, item_text)
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")).filter("text is not null")

    def search(sent):
        def run(batches):
            index = sent.value
            for batch in batches:
                for s in A.slices(batch, "text"):
                    found = find(index, A.column(s, "text"))
                    if found:
                        f = np.array(found, np.int64)
                        take = pa.array(f[:, 0])
                        item = index.ids[f[:, 1]]
                        yield pa.RecordBatch.from_arrays(
                            [A.column(s, "doc_id").take(take), pa.array(item), pa.array(f[:, 3] - f[:, 2]), pa.array(f[:, 4]), A.column(s, "text_hash").take(take)],
                            ["doc_id", "item_id", "matched", "edits", "text_hash"],
                        )

        return run

    def pass_of(part):
        sent = spark.sparkContext.broadcast(Index([-1 if i is None else i for i, _ in part], [t for _, t in part]))
        return pair.mapInArrow(A.released(search(sent)), "doc_id long, item_id long, matched long, edits long, text_hash long")

    out, part, size = None, [], 0
    for i, t in items.toLocalIterator():
        part.append((i, t))
        size += len(t)
        if size > INDEX_LETTERS:
            found, part, size = pass_of(part), [], 0
            out = found if out is None else out.unionByName(found)
    if part or out is None:
        found = pass_of(part)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_id", "item_id", "text_hash").agg(F.max("matched").alias("matched"), F.min("edits").alias("edits"))
    return best.select("doc_id", F.nullif("item_id", F.lit(-1)).alias("item_id"), "matched", "edits", "text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns, whatever their names.

    Null texts stay. Repeated rows go or stay together; an empty table gives an empty one.
    """
    found = materialise(contaminated(docs, benchmark, id_col, text_col).select("text_hash", "doc_id").distinct(), "contaminated")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{names.index(text_col)}").cast("string")
    return plain.join(sent_if_small(found), (F.xxhash64(text) == found["text_hash"]) & key.eqNullSafe(found["doc_id"]), "left_anti").toDF(*names)

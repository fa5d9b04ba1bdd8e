"""Line dedup: content-defined chunks of lines, removed where they repeat anywhere in the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.runtime import require

#: A chunk ends after a line when the rolling hash of it and the line before is 0 modulo this; half of them are.
DIVISOR = 2
#: Only chunks of at least so many lines and bytes are removed.
MIN_LINES, MIN_BYTES = 2, 60
#: A single line repeats by itself when it has more words than this.
LINE_WORDS = 50
#: Pieces that a task holds, with their bytes, to find those that it has itself at an earlier place.
HELD = 200_000
#: Size of the bitmap of repeated hashes.
BITMAP_BITS = 27

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line without the white space around it, and its row.

    A line ends at a line break, or at the end of a sentence (. ! ? before white space), so that prose without line
    breaks has lines too. Blank lines are left out.
    """
    n = len(data)
    space = _SPACE[data]
    after_space = np.ones(n, bool)
    after_space[:-1] = space[1:]
    cut = (data == 10) | (_STOP[data] & after_space)
    bounds = np.unique(np.r_[offs, np.flatnonzero(cut) + 1])
    solid = np.zeros(n + 1, np.int64)
    np.cumsum(~space, out=solid[1:])
    where = np.flatnonzero(~space)
    a, b = bounds[:-1], bounds[1:]
    some = solid[b] > solid[a]
    a, b = a[some], b[some]
    return where[solid[a]], where[solid[b] - 1] + 1, np.searchsorted(offs, a, side="right") - 1


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row, number of lines and hash of each chunk.

    The rolling hash takes in the line and the one before, and nothing of its place; so wherever a passage stands,
    its chunks are cut alike from its second line on.
    """
    start, end, row = lines(data, offs)
    if len(start) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64)
    h = A.span_hashes(data, start, end)
    before = np.r_[np.uint64(0), h[:-1]]
    new_row = np.r_[True, row[1:] != row[:-1]]
    before[new_row] = 0
    rolled = A.mix(h * np.uint64(3) + before * np.uint64(0x9E3779B97F4A7C15))
    last = (rolled % np.uint64(DIVISOR) == 0) | np.r_[new_row[1:], True]
    stop = np.flatnonzero(last)
    first = np.r_[0, stop[:-1] + 1]
    a, b = start[first], end[stop]
    return a, b, row[first], stop - first + 1, A.span_hashes(data, a, b, seed=7)


def _removable(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Start, end, row, hash and place of the next chunk (or the row's end) of the chunks that may be removed."""
    data, offs = A.text_bytes(texts)
    a, b, row, count, h = chunks(data, offs)
    after = np.r_[a[1:], 0][: len(a)]
    last = np.r_[row[1:] != row[:-1], True][: len(a)]
    after = np.where(last, offs[row + 1], after) if len(a) else after
    ok = (count >= MIN_LINES) & (b - a >= MIN_BYTES)
    return a[ok], b[ok], row[ok], h[ok], after[ok], data, offs


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last line and hash of each shortest run worth removing, and start, end and row of all lines.

    From each line on, and up to each line, the shortest run of MIN_LINES lines and MIN_BYTES bytes, or the line
    alone if it has over LINE_WORDS words. A run depends on its lines alone, not on what surrounds them or on the
    white space between them. Every longer repeated run is covered by those inside it: a line from which none begins
    in the run lies in the one that ends with the run's last line.
    """
    start, end, row = lines(data, offs)
    n = len(start)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), start, end, row
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[start] = True
    words = np.r_[0, np.cumsum(begins)]
    alone = words[end] - words[start] > LINE_WORDS
    size = np.r_[0, np.cumsum(end - start + 1)]
    at = np.arange(n)
    to = np.maximum(np.searchsorted(size, size[:-1] + MIN_BYTES + 1) - 1, at + MIN_LINES - 1)
    to = np.where(alone, at, to)
    fits = to < n
    fits[fits] = row[to[fits]] == row[fits]
    since = np.minimum(np.searchsorted(size, size[1:] - MIN_BYTES - 1, side="right") - 1, at - MIN_LINES + 1)
    since = np.where(alone, at, since)
    new = since >= 0
    new[new] = (row[since[new]] == row[new]) & (to[since[new]] != at[new])
    first, last = np.r_[at[fits], since[new]], np.r_[to[fits], at[new]]
    pw, inv = A.powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(A.span_hashes(data, start, end) * pw[:n], out=total[1:])
    h = A.mix((total[last + 1] - total[first]) * inv[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return first, last, h, start, end, row


def _runs(texts: pa.Array) -> tuple:
    """Row, hash, start and place of the next line (or the row's end) of the windows, and their lines' bytes by index."""
    data, offs = A.text_bytes(texts)
    first, last, h, start, end, row = windows(data, offs)
    after = np.r_[start[1:], 0][: len(start)]
    final = np.r_[row[1:] != row[:-1], True][: len(start)]
    after = np.where(final, offs[row + 1], after) if len(start) else after
    raw = data.tobytes()

    def bodies(picked: np.ndarray) -> list[bytes]:
        return [b"\n".join([raw[start[k] : end[k]] for k in range(i, j + 1)]) for i, j in zip(first[picked].tolist(), last[picked].tolist())]

    return row[first], h, start[first], after[last], offs, bodies


def _chunks(texts: pa.Array) -> tuple:
    """As ``_runs``, of the chunks."""
    a, b, row, h, after, data, offs = _removable(texts)
    return row, h, a, after, offs, lambda picked: [data[i:j].tobytes() for i, j in zip(a[picked].tolist(), b[picked].tolist())]


def repeated_bits(texts: DataFrame, pieces=_chunks) -> np.ndarray:
    """A bitmap of BITMAP_BITS with the bits of the hashes that occur twice or more, and of others by chance."""

    def run(batches):
        for batch in batches:
            for s in A.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(pieces(A.column(s, "text"))[1].view(np.int64))], ["hash"])

    twice = texts.mapInArrow(A.released(run), "hash long").groupBy("hash").count().filter("count > 1")
    slot = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    words = twice.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", report: bool = False, whole: bool = False) -> DataFrame:
    """``docs`` with every repeated chunk of two or more lines removed, but for its first occurrence.

    ``whole`` removes every repeated run of lines instead, from its first line to its last, wherever chunks would end:
    all runs of two or more lines and 60 bytes, and single lines of over 50 words, that stand at an earlier place
    too. Equal lines are equal whatever white space is between them. What is said of chunks below then goes for these
    runs; runs that touch are cut, and reported, as one.

    Three passes. The first counts the hashes of chunks, without texts. Those seen twice go into a bitmap of fixed
    size (16 MB); should it fill up, more chunks than need be take part in the second pass. There each task compares
    the chunks that may repeat with those it has seen, byte by byte; what it has at an earlier place itself goes, and
    only the first of equal chunks is shuffled, by hash, with its bytes, to be compared with those of other tasks. So
    of a chunk of any number of copies no task gets more than each task's first. The third pass joins what is to be
    cut to the texts, which are shuffled once.

    First is the smallest (doc_id, text hash, place), null ids first. A chunk that repeats within one document goes
    as well. White space after a removed chunk goes with it; text that is kept is kept to the byte. Null texts stay
    null, empty ones empty; very long ones are cut like others; a text of nothing but repeated chunks becomes empty,
    and its row stays. Rows that repeat both id and text are one document and are cut alike, so ties don't arise. All
    columns are kept under their names (``chars_col``, if there is one of that name, becomes the new length), whatever
    these are: the operator's own columns are added to numbered ones. An empty table gives an empty one. ``report``
    gives (doc_id, text, removed_chunks, removed_bytes) instead.
    """
    require(docs, id_col, text_col)
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, key = F.col(f"c{names.index(text_col)}").cast("string"), F.col(f"c{names.index(id_col)}").cast("long")
    texts = numbered.select(key.alias("id"), text.alias("text")).filter("text is not null")
    pieces = _runs if whole else _chunks
    sent = docs.sparkSession.sparkContext.broadcast(repeated_bits(texts.select("text"), pieces))

    def pick(batches):
        held: dict[int, tuple] = {}

        def rows(out):
            id_, text_hash, start, stop, hash_, body = zip(*out) if out else ((),) * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((id_, text_hash, hash_, start, stop, body), kinds)], ["id", "text_hash", "hash", "start", "stop", "body"])

        for batch in batches:
            for s in A.slices(batch, "text"):
                row, h, a, after, offs, bodies = pieces(A.column(s, "text"))
                slot = h >> np.uint64(64 - BITMAP_BITS)
                ok = np.flatnonzero((sent.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                a, row, h, after = a[ok], row[ok], h[ok], after[ok]
                ids, text_hashes = A.column(s, "id").to_pylist(), A.column(s, "text_hash").to_pylist()
                at = offs[row]
                out = []
                for r, k, begin, end, body in zip(row.tolist(), h.view(np.int64).tolist(), (a - at).tolist(), (after - at).tolist(), bodies(ok)):
                    i = ids[r]
                    now = ((i is not None, i or 0, text_hashes[r], begin), (i, text_hashes[r], begin, end, k, body))
                    other = held.get(k)
                    if other is None:
                        held[k] = now
                    elif other[1][5] != body:
                        out.append(now[1])
                    elif now[0] != other[0]:
                        if now[0] < other[0]:
                            held[k], now = now, other
                        out.append((*now[1][:5], None))
                if len(held) > HELD:
                    out += [x for _, x in held.values()]
                    held = {}
                yield rows(out)
        yield rows([x for _, x in held.values()])

    picked = texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(A.released(pick), "id long, text_hash long, hash long, start int, stop int, body binary")
    # what goes already has no bytes, and is spread over the partitions
    picked = picked.withColumn("hash", F.when(F.col("body").isNull(), F.xxhash64("id", "text_hash", "start")).otherwise(F.col("hash")))
    same = Window.partitionBy("hash", "body").orderBy("id", "text_hash", "start")
    gone = picked.repartition("hash").withColumn("copy", F.dense_rank().over(same)).filter("copy > 1 or body is null")
    if whole:
        order = Window.partitionBy("id", "text_hash").orderBy("start", "stop")
        reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
        apart = gone.select("id", "text_hash", "start", "stop").withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
        apart = apart.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        gone = apart.groupBy("id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    cuts = gone.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("cuts"))
    joined = numbered.join(cuts, key.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("text_hash")), "left")
    raw = text.cast("binary")

    def between(_, i):
        """Bytes from the end of cut i - 1 to the start of cut i."""
        begin = F.when(i == 0, F.lit(0)).otherwise(F.col("cuts")[i - 1]["stop"])
        end = F.when(i == F.size("cuts"), F.octet_length(raw)).otherwise(F.try_element_at(F.col("cuts"), i + 1)["start"])
        return F.substring(raw, begin + 1, end - begin).cast("string")

    kept = F.array_join(F.transform(F.array_append(F.transform("cuts", lambda c: c["start"]), F.lit(0)), lambda x, i: between(x, i)), "")
    left = F.when(F.col("cuts").isNull(), text).otherwise(kept)
    if report:
        lost = F.aggregate(F.coalesce("cuts", F.array().cast("array<struct<start:int,stop:int>>")), F.lit(0).cast("long"), lambda a, c: a + c["stop"] - c["start"])
        count = F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts")).cast("long")
        return joined.select(F.col(f"c{names.index(id_col)}").alias("doc_id"), left.alias("text"), count.alias("removed_chunks"), lost.alias("removed_bytes"))
    chars = F.length(left).cast(docs.schema[chars_col].dataType) if chars_col in names else None
    return joined.select(*[(left if c == text_col else chars if c == chars_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])

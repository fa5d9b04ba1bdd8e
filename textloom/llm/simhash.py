"""SimHash near-duplicates: an exact Hamming join by chunks with few differences, pigeonring chains, full check."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.operators.components import connected_components
from textloom.runtime import materialise, require, sent_if_small

BITS = 256
#: Two documents are near-duplicates when their fingerprints differ in at most this many of the 256 bits.
MAX_DISTANCE = 44
#: Fingerprints of a block, at most; a task compares two blocks. Fewer have smaller blocks, down to SMALL_BLOCK.
BLOCK, SMALL_BLOCK = 1 << 18, 1 << 12
#: The ring of the pigeonring test: 8 boxes of 32 bits, chains of 4 boxes.
BOXES, CHAIN = 8, 4
#: Whatever has a word: a byte of A.WORD.
_WORD = r"[0-9A-Za-z_]|[^\x00-\x7F]"
_PAIRS_AT_ONCE = 1 << 19
_WORDS_AT_ONCE = 50_000
#: Nodes of a bucket from which on those that are linked already are passed over together.
_CROWD = 64
#: Links that are held before they are joined.
_LINKS_HELD = 1 << 16
#: Links between blocks that one task connects, at most; more are connected by rounds over tables.
LINKS_AT_ONCE = 1 << 20
#: Nanoseconds to look up a bucket and to test a candidate, about; only their ratio matters.
_LOOKUP, _TEST = 6, 8

_LANES = np.array([sum(((v >> k) & 1) << (16 * k) for k in range(4)) for v in range(16)], np.uint64)
_SEEDS = [np.uint64((q + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for q in range(BITS // 64)]


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) words of the fingerprint and whether the row has any word.

    Features are the distinct lower-case words; bit j is the majority of bit j of their hashes. Counting goes by
    16-bit lanes inside 64-bit words; rows of more words than a lane can count are added up in parts.
    """
    data, offs = A.text_bytes(pc.utf8_lower(texts))
    starts, ends, rows = A.word_spans(data, offs)
    n = len(texts)
    if len(starts) == 0:
        return np.zeros((n, BITS // 64), np.uint64), np.zeros(n, bool)
    h = A.span_hashes(data, starts, ends)
    in_row = A.mix(h ^ (rows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    keep = np.sort(np.unique(in_row, return_index=True)[1])
    h, rows = h[keep], rows[keep]
    first = A.row_starts(rows, n)
    count = np.diff(first)
    some = np.flatnonzero(count)
    parts = -(-count[some] // _WORDS_AT_ONCE)
    owner = np.repeat(some, parts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = first[owner] + within * _WORDS_AT_ONCE
    bits = np.empty((len(h), BITS // 8), np.uint8)
    for q, seed in enumerate(_SEEDS):
        bits[:, q * 8 : q * 8 + 8] = A.mix(h + seed).view(np.uint8).reshape(-1, 8)
    ones = np.zeros((n, BITS), np.int64)
    for q in range(BITS // 8):
        for half in (0, 4):
            lanes = np.add.reduceat(_LANES[(bits[:, q] >> half) & 15], cut).view(np.uint16).reshape(-1, 4).astype(np.int64)
            at = slice(q * 8 + half, q * 8 + half + 4)
            if len(owner) == len(some):
                ones[some, at] = lanes
            else:
                np.add.at(ones[:, at], owner, lanes)
    packed = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little")
    return packed.view(np.uint64), count > 0


def pigeonring(diff: np.ndarray, most: int = MAX_DISTANCE) -> np.ndarray:
    """Which rows of (n, 4) xor words can be within ``most``: some chain of boxes keeps all its prefixes in budget.

    If the whole ring holds at most t differences, then from some box on every prefix of l boxes holds at most
    l * t / BOXES; so rows without such a start are beyond t and nothing within t is lost.
    """
    box = np.bitwise_count(np.ascontiguousarray(diff).view(np.uint32)).astype(np.int32)
    total, viable = np.zeros_like(box), np.ones(box.shape, bool)
    for k in range(CHAIN):
        total += np.roll(box, -k, axis=1)
        viable &= total * BOXES <= (k + 1) * most
    return viable.any(axis=1)


def within(x: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = MAX_DISTANCE) -> np.ndarray:
    diff = x[a] ^ x[b]
    ok = np.flatnonzero(pigeonring(diff, most))
    out = np.zeros(len(a), bool)
    out[ok] = np.bitwise_count(diff[ok]).sum(axis=1) <= most
    return out


@functools.cache
def chunk_plan(n: int, most: int = MAX_DISTANCE) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of the chunks that the ring is cut into, for blocks of n fingerprints.

    The radii and one for each chunk add up to ``most`` + 1. So two fingerprints within ``most`` differ in at most
    the radius in some chunk: if not, they'd differ in more than ``most`` bits. A chunk of radius -1 is not looked at.
    More chunks have smaller radii, so fewer lookups and more candidates; the cheapest number for n is taken.
    """
    best, plan = math.inf, []
    for m in range(8, 33):
        cuts = [BITS * i // m for i in range(m + 1)]
        radii = [(most + 1) // m - 1 + (i < (most + 1) % m) for i in range(m)]
        bits = [b - a for a, b in zip(cuts, cuts[1:])]
        if max(bits) > 22:
            continue
        lookups = [sum(math.comb(w, k) for k in range(r + 1)) for w, r in zip(bits, radii)]
        cost = sum(_LOOKUP * x + _TEST * n * x / 2**w for x, w in zip(lookups, bits))
        if cost < best:
            best, plan = cost, list(zip(cuts, bits, radii))
    return plan


@functools.cache
def _flips(bits: int, radius: int) -> list[int]:
    """All values of so many bits with at most ``radius`` ones."""
    return [sum(1 << i for i in c) for k in range(radius + 1) for c in itertools.combinations(range(bits), k)]


def _turned(words: np.ndarray, first: int) -> np.ndarray:
    """64 bits of the ring from bit ``first`` on."""
    k, shift = divmod(first, 64)
    low = words[:, k]
    return low >> np.uint64(shift) | words[:, (k + 1) % 4] << np.uint64(64 - shift) if shift else low.copy()


def _ranges(lo: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index, its count, places lo .. lo + count of all indexes), some hundred thousand places at once."""
    some = np.flatnonzero(count)
    total = np.cumsum(count[some])
    done = 0
    while done < len(some):
        base = total[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(total, base + _PAIRS_AT_ONCE, side="right")))
        at = some[done:stop]
        n = count[at]
        before = total[done:stop] - base - n
        yield at, n, np.repeat(lo[at] - before, n) + np.arange(total[stop - 1] - base)
        done = stop


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes is joined to by the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _reach(words: np.ndarray, most: int) -> np.ndarray:
    """Label of each node of a crowd: nodes joined by links within ``most``, however many steps, get the same.

    From each node that is reached, only nodes that aren't reached yet are looked at; so a crowd of copies takes a few
    passes, and no link between groups is missed.
    """
    label = np.full(len(words), -1)
    left = np.arange(len(words))
    while len(left):
        queue, name = [left[0]], left[0]
        label[left[0]], left = name, left[1:]
        while queue and len(left):
            now = queue.pop()
            near = np.bitwise_count(words[left] ^ words[now]).sum(axis=1) <= most
            label[left[near]] = name
            queue.extend(left[near].tolist())
            left = left[~near]
    return label


def _links(words: np.ndarray, first: int, most: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smaller node) that connect what links within ``most`` connect between two blocks.

    ``words`` holds the first block and then the second; without a second one, links within the first are meant. By
    chunk (``chunk_plan``), nodes of the first block look up the nodes of the second whose chunk differs in at most its
    radius. By the pigeonring principle, a pair within the limit has a chunk from which on also every chain of
    chunks is within the sum of what they are allowed; so candidates beyond that, in the chunks that 64 bits hold, go before
    the full check, and no pair within the limit is lost. Pairs that are connected already needn't be linked again.
    """
    n = len(words)
    label = np.arange(n)
    second = first if first < n else 0
    within_one = second == 0
    plan = chunk_plan(max(1, n - second), most)

    found = []
    for k, (begin, bits, radius) in enumerate(plan):
        if radius < 0:
            continue
        turned = _turned(words, begin)
        value = turned & np.uint64((1 << bits) - 1)
        label = _joined(label, _crowds(words, value, label, most))
        # the longest chain of chunks that 64 bits hold
        chain, allowed = bits, radius + 1
        for i in range(k + 1, k + len(plan)):
            if chain + plan[i % len(plan)][1] > 64:
                break
            chain, allowed = chain + plan[i % len(plan)][1], allowed + plan[i % len(plan)][2] + 1
        seen = np.uint64((1 << chain) - 1)
        # both sides by value, and by label as far as it is known
        sorted_by = (value << np.uint64(32)) | label.astype(np.uint64)
        order_a = np.argsort(sorted_by[:first])
        order_b = np.argsort(sorted_by[second:]) + second if not within_one else order_a
        by_a, by_b = sorted_by[order_a], sorted_by[order_b]
        value_a, word_a, word_b = value[order_a].astype(np.int64), turned[order_a] & seen, turned[order_b] & seen
        starts = np.zeros((1 << bits) + 1, np.int64)
        starts[1:] = np.cumsum(np.bincount(value[order_b].astype(np.int64), minlength=1 << bits))
        for flip in _flips(bits, radius):
            if within_one and flip:  # each pair from the side whose highest flipped bit is unset
                mine = np.flatnonzero(value_a & (1 << (flip.bit_length() - 1)) == 0)
            else:
                mine = np.arange(len(value_a))
            other = value_a[mine] ^ flip
            lo = starts[other]
            count = starts[other + 1] - lo
            if within_one and not flip:  # each node and those after it
                count -= mine + 1 - lo
                lo = mine + 1
            big = np.flatnonzero(count > _CROWD)
            if len(big):
                key = (by_a[mine[big]] & np.uint64((1 << 32) - 1)) | other[big].astype(np.uint64) << np.uint64(32)
                end = lo[big] + count[big]
                left = np.clip(np.searchsorted(by_b, key, side="left"), lo[big], end)
                right = np.clip(np.searchsorted(by_b, key, side="right"), lo[big], end)
                count[big] = left - lo[big]
                mine, lo, count = np.r_[mine, mine[big]], np.r_[lo, right], np.r_[count, end - right]
            for at, many, place in _ranges(lo, count):
                ok = np.flatnonzero(np.bitwise_count(np.repeat(word_a[mine[at]], many) ^ word_b[place]) < allowed)
                if len(ok) == 0:
                    continue
                a = order_a[mine[at[np.searchsorted(np.cumsum(many), ok, side="right")]]]
                b = order_b[place[ok]]
                new = label[a] != label[b]
                a, b = a[new], b[new]
                near = within(words, a, b, most)
                found.append((a[near], b[near]))
                if sum(len(x) for x, _ in found) > _LINKS_HELD:
                    label, found = _joined(label, found), []
        label, found = _joined(label, found), []
    b = np.flatnonzero(label != np.arange(n))
    return b, label[b]


def _crowds(words: np.ndarray, value: np.ndarray, label: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked among the nodes of one value, where many share it and aren't all joined already."""
    order = np.argsort(value, kind="stable")
    cut = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]])
    sizes = np.diff(np.r_[cut, len(order)])
    found = []
    for begin, size in zip(cut[sizes > _CROWD].tolist(), sizes[sizes > _CROWD].tolist()):
        crowd = order[begin : begin + size]
        if (label[crowd] != label[crowd[0]]).any():
            found.append((crowd, crowd[_reach(words[crowd], most)]))
    return found


def _joined(label: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The labels when the found links are added."""
    if not sum(len(a) for a, _ in found):
        return label
    every = np.arange(len(label))
    return _stars(len(label), np.concatenate([every, *(a for a, _ in found)]), np.concatenate([label, *(b for _, b in found)]))


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, f0 .. f3) of the documents that have an id and at least one word."""

    def run(batches):
        for batch in batches:
            for s in A.slices(batch, "text", 1 << 20):
                words, some = fingerprints(A.column(s, "text"))
                ids = A.column(s, "doc_id").filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(words[some, k].view(np.int64)) for k in range(4))], ["doc_id", "f0", "f1", "f2", "f3"])

    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return pair.mapInArrow(A.released(run), "doc_id long, f0 long, f1 long, f2 long, f3 long")


def _row_prints(docs: DataFrame, originals: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of the rows' texts, and of the texts that rows of their ids have in ``originals``."""
    prints = fingerprint_table(docs, id_col, text_col)
    if originals is None:
        return prints
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null")
    before = fingerprint_table(originals, id_col, text_col).join(ids, "doc_id", "left_semi")
    return prints.unionByName(before)


def _components(links: DataFrame) -> DataFrame:
    """``connected_components`` of (a, b), without its rounds where one task can hold the links: each writes a table."""
    links = materialise(links.filter("a <> b").distinct(), "simhash-links")
    if links.count() > LINKS_AT_ONCE:
        return connected_components(links)

    def run(batches):
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            a, b = (np.concatenate(x) for x in zip(*held))
            nodes, at = np.unique(np.r_[a, b], return_inverse=True)
            label = _stars(len(nodes), at[: len(a)], at[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])

    return links.repartition(1).mapInArrow(A.released(run), "node long, component long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, originals: DataFrame | None = None) -> DataFrame:
    """(doc_id, group_id, group_size, kept): every document that has a near-duplicate, with its group.

    Fingerprints have 256 bits; documents of one fingerprint are one node, so thousands of exact copies cost one
    row. All nodes are compared with all, two blocks of them in a task, and every pair within ``max_distance`` is found:
    candidates differ little in some chunk of the bits (``chunk_plan``), then come the pigeonring chains and the full
    check (``_links``). Each node is sent once for each block, so shuffled fingerprints grow as the square of the nodes
    from BLOCK nodes a block on, as do the tests. Groups are connected components; ``group_id`` is the smallest doc_id
    and that document is ``kept``.

    ``originals`` holds earlier texts of the documents under the same column names: then two documents are also
    near-duplicates when these are, whatever has been cut out of them since.

    Null ids can't be referred to and are left out, as are null, empty and wordless texts. Very long texts are
    fingerprinted whole. Rows that repeat a doc_id are one document with several texts (it is in a group with others
    only, and listed once). Ties between copies go to the smallest doc_id. Empty tables give no rows. Other columns
    are not read, whatever their names.
    """
    require(docs, id_col, text_col)
    words = ["f0", "f1", "f2", "f3"]
    # in few files: for each that is opened, an executor starts other processes, whose memory counts twice until they run
    prints = materialise(_row_prints(docs, originals, id_col, text_col).repartition("doc_id"), "simhash")
    nodes = materialise(prints.select(*words).distinct().withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    count = nodes.count()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-count // BLOCK), min(math.isqrt(4 * cores), -(-count // SMALL_BLOCK)))
    own, other = F.col("own"), F.col("other")
    high = F.greatest(own, other)
    filed = nodes.withColumn("own", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    filed = filed.select((high * (high + 1) / 2 + F.least(own, other)).cast("int").alias("task"), (own > other).alias("second"), "node", *words)

    def compare(batches):
        held = ([], [])
        for batch in batches:
            second = batch.column(1)
            for side, mask in ((0, pc.invert(second)), (1, second)):
                part = batch.filter(mask)
                held[side].append([part.column(i).to_numpy() for i in range(2, 7)])
        sides = [x for side in held for x in side]
        if not sides:
            return
        first = sum(len(x[0]) for x in held[0])
        node = np.concatenate([x[0] for x in sides])
        w = np.empty((len(node), 4), np.int64)
        for i in range(4):
            np.concatenate([x[i + 1] for x in sides], out=w[:, i])
        held[0].clear(), held[1].clear(), sides.clear()
        if 0 < first:
            a, b = _links(w.view(np.uint64), first, max_distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    tasks = blocks * (blocks + 1) // 2
    pairs = filed.repartitionById(tasks, F.col("task")).mapInArrow(A.released(compare), "a long, b long")
    owned = materialise(prints.join(nodes, words).select("doc_id", "node").distinct(), "simhash-owned")
    # a document of several texts joins their nodes
    same = owned.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.collect_set("node").alias("b")).filter("a < z")
    pairs = pairs.unionByName(same.select("a", F.explode("b").alias("b")).filter("a <> b"))
    roots = _components(pairs)
    named = owned.join(roots, "node", "left").select("doc_id", F.coalesce("component", "node").alias("group"))
    members = named.groupBy("doc_id").agg(F.min("group").alias("group"))
    sizes = members.groupBy("group").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return members.join(sizes, "group").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, wordless: bool = False, originals: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group, the one of the smallest id.

    Rows without id, text or words have no near-duplicates and stay; with ``wordless``, equal texts without words are
    a group like others. ``originals`` as in ``near_duplicate_groups``. Where rows repeat a doc_id, the row with the
    smallest text stays. An empty table gives an empty one. All columns and their names are kept, also names that
    clash with those used here.
    """
    require(docs, id_col, text_col)
    names = docs.columns
    groups = near_duplicate_groups(docs, id_col, text_col, max_distance, originals)
    losers = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("loser"))
    if wordless:
        pair = docs.select(F.col(id_col).cast("long").alias("loser"), F.col(text_col).cast("string").alias("t"))
        pair = pair.filter(F.col("loser").isNotNull() & ~F.col("t").rlike(_WORD))
        first = pair.groupBy("t").agg(F.min("loser").alias("first"))
        losers = losers.unionByName(pair.join(first, "t").filter(F.col("loser") > F.col("first")).select("loser"))
    losers = materialise(losers, "simhash-losers")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    kept = plain.join(sent_if_small(losers), key.cast("long") == losers["loser"], "left_anti")
    repeated = materialise(plain.groupBy(key.alias("again")).agg(F.count("*").alias("n")).filter("again is not null and n > 1").select("again"), "simhash-again")
    if repeated.limit(1).count():
        # only these rows are shuffled, with their texts
        once = kept.join(repeated, key == repeated["again"], "left_anti")
        order = Window.partitionBy(key).orderBy(text.asc_nulls_last())
        more = kept.join(repeated, key == repeated["again"], "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
        kept = once.unionByName(more)
    return kept.toDF(*names)

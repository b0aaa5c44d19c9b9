"""Exact substring dedup: every byte that a LEAST-byte string covers which also starts anywhere else.

A suffix array of all bytes would be many times the corpus, so a sparse one is built. Of the hashes of GRAM-byte
strings in each LEAST-byte window the least is the window's anchor; equal windows have their anchors at the same
place, so two equal windows meet at anchors with equal hashes. An anchor's context reaches as far to both sides
as any window that holds its gram.

Anchors whose whole context occurs again cover it. For each other context, the contexts of a hash are a group: the
suffixes from the anchor on, sorted, with their common prefixes form an enhanced suffix array. A stack scan runs
over its interval tree; an interval of depth r holds all places that share r bytes to the right. Inside it the
left extensions are told apart: with a partner that shares l bytes to the left, l + r >= LEAST, the place covers l
bytes before and r after. All intervals of an anchor hold its gram, so their union is one span.

Groups over HOT contexts are split by the hashes of the windows themselves, which spread over all tasks.

``maximal_repeats`` gives the groups themselves: each string of LEAST bytes or more, as far as contexts reach, that no
byte to the left or right extends at all of its places, with all of those. ``drop_repeats`` needs only how far they reach.

Null texts count as empty; texts under LEAST bytes lose nothing, nor does an empty table; repeated rows are copies of
each other and lose all they share; ties between equal contexts keep none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SLICE, flat, mix, powers, prefix_hashes, slices, whole_runs
from .common import Workspace, table

LEAST, GRAM, HOT = 200, 32, 20_000
LEFT = LEAST - GRAM
_PLACE = np.uint64((1 << 22) - 1)


def _hash(h: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))


def _minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width keys in a row, by doubling."""
    done, out = 1, keys
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, first: int = 0, past: int | None = None) -> np.ndarray:
    """Places of the anchors of the windows that start from first to past in the bytes of one or more rows."""
    n = len(data) - LEAST + 1
    past = n if past is None else min(past, n)
    if past <= first:
        return np.zeros(0, np.int64)
    h = prefix_hashes(data)
    at = np.arange(first, past + LEFT)
    grams = _hash(h, powers(len(data) + 1)[1], at, at + GRAM)
    # a hash in the high bits, the place in the low ones: the least is the leftmost of the least
    return (_minima((grams & ~_PLACE) | at.astype(np.uint64), LEFT + 1) & _PLACE).astype(np.int64)


ANCHORS = "h long, ctx long, rid long, off long, l int, r int"


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, ctx, rid, off, l, r) for each anchor of docs (rid, text); the context is l bytes before off to r after."""
    names = ["h", "ctx", "rid", "off", "l", "r"]

    def rows(data: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
        h, inverse = prefix_hashes(data), powers(len(data) + 1)[1]
        l, r = np.minimum(before, LEFT), np.minimum(after, LEAST)
        ctx = mix(_hash(h, inverse, place - l, place + r) ^ (l * 256 + r).astype(np.uint64))
        return _hash(h, inverse, place, place + GRAM).view(np.int64), ctx.view(np.int64), l.astype(np.int32), r.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            data, offsets = flat(batch.column(1))
            for i, j, d, o in slices(data, offsets, SLICE):
                if len(d) <= SLICE:
                    found = anchors(d)
                    start = np.arange(len(found))
                    row = np.searchsorted(o, start, "right") - 1
                    found, row = (x[start + LEAST <= o[row + 1]] for x in (found, row))
                    new = np.ones(len(found), bool)
                    new[1:] = found[1:] != found[:-1]
                    found, row = found[new], row[new]
                    h, ctx, l, r = rows(d, found, found - o[row], o[row + 1] - found)
                    cols = [h, ctx, rid[i + row], found - o[row], l, r]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
                    continue
                last, n = -1, len(d)  # one long text, in pieces
                for c in range(0, n - LEAST + 1, SLICE):
                    lo = max(0, c - LEFT)
                    part = d[lo : c + SLICE + 2 * LEAST]
                    found = np.unique(anchors(part, c - lo, c - lo + SLICE))
                    found = found[found + lo > last]
                    if len(found):
                        last = int(found[-1]) + lo
                        h, ctx, l, r = rows(part, found, found + lo, n - lo - found)
                        cols = [h, ctx, np.full(len(found), rid[i]), found + lo, l, r]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return docs.select("rid", "text").mapInArrow(run, ANCHORS)


def _reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows of padded bytes with lengths na and nb."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, np.minimum(na, nb))


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    n = np.diff(offsets)
    out = np.zeros((len(n), width), np.uint8)
    at = np.arange(width)[None] < n[:, None]
    out[at] = data
    return out, n


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of an enhanced suffix array, by a stack scan; lcp[i] is of i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def extents(right: np.ndarray, nr: np.ndarray, left: np.ndarray, nl: np.ndarray, lcp: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before, bytes after) that repeats of at least least bytes cover, for each place of one group.

    right: sorted suffixes from the place on; left: what stands before, read backwards.
    """
    before, after = np.zeros(len(nr), np.int64), np.zeros(len(nr), np.int64)
    rank = np.empty(len(nl), np.int64)
    rank[np.lexsort((nl, left.copy().view(f"S{left.shape[1]}").ravel()))] = np.arange(len(nl))
    for depth, first, last in intervals(lcp):
        if depth < GRAM:
            continue
        # neighbours in the order of left extensions share most; where they differ, the repeat is maximal
        members = first + np.argsort(rank[first : last + 1])
        shared = _reach(left[members[1:]], left[members[:-1]], nl[members[1:]], nl[members[:-1]])
        best = np.zeros(len(members), np.int64)
        best[1:] = shared
        best[:-1] = np.maximum(best[:-1], shared)
        ok = best + depth >= least
        some = members[ok]
        before[some] = np.maximum(before[some], best[ok])
        after[some] = np.maximum(after[some], depth)
    return before, after


def maximal(right: np.ndarray, nr: np.ndarray, left: np.ndarray, nl: np.ndarray, lcp: np.ndarray, single: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes before, bytes after, places) of the maximal repeats of one group, in the order and form of extents.

    Inside an interval the left extensions form a tree of their own, scanned alike. Its nodes part to the left; those whose places
    lie in several children of the interval part to the right too. A context that recurs is a repeat by itself, unless another place shares all of it.
    """
    shown, rank = np.zeros(len(nr), bool), np.empty(len(nl), np.int64)
    rank[np.lexsort((nl, left.copy().view(f"S{left.shape[1]}").ravel()))] = np.arange(len(nl))
    for depth, first, last in intervals(lcp):
        if depth < GRAM:
            continue
        child = np.concatenate([[0], np.cumsum(lcp[first:last] == depth)])
        members = first + np.argsort(rank[first : last + 1])
        shared = _reach(left[members[1:]], left[members[:-1]], nl[members[1:]], nl[members[:-1]])
        for before, a, b in intervals(shared):
            places = members[a : b + 1]
            kids = child[places - first]
            if before + depth >= least and (kids != kids[0]).any():
                shown[places[(nl[places] == before) & (nr[places] == depth)]] = True
                yield before, depth, places
    for k in np.flatnonzero(~single & ~shown & (nl + nr >= least)):
        yield int(nl[k]), int(nr[k]), np.array([k])


SPANS = "rid long, start long, end long"
REPEATS = "h long, rid long, off long, repeat string, before int, after int"


def group_repeats(contexts: DataFrame, parts: int) -> DataFrame:
    """REPEATS: each context (h, rid, off) with each maximal repeat of its group that it holds, named by a 128-bit hash of its bytes.

    A repeat comes from the anchors of windows inside it, which all its places share, so none of these is missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_runs(batches, ["h"]):
            right, nr = _padded(batch.column("right"), LEAST)
            left, nl = _padded(batch.column("left"), LEFT)
            h, rid, off, single = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "rid", "off", "single"))
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                z = slice(s, e)
                lcp = _reach(right[s + 1 : e], right[s : e - 1], nr[s + 1 : e], nr[s : e - 1])
                for before, after, places in maximal(right[z], nr[z], left[z], nl[z], lcp, single[z]):
                    one = s + places[0]
                    data = np.concatenate([left[one, :before][::-1], right[one, :after]])
                    if before in anchors(data):
                        n, at = len(places), s + places
                        name = hashlib.blake2b(data.tobytes(), digest_size=16).hexdigest()
                        cols = [h[at], rid[at], off[at], [name] * n, np.full(n, before, np.int32), np.full(n, after, np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "rid", "off", "repeat", "before", "after"])

    dealt = contexts.select("h", "rid", "off", "single", "left", "right").repartition(parts, "h")
    return dealt.sortWithinPartitions("h", "right", "rid", "off").mapInArrow(run, REPEATS)


def group_spans(contexts: DataFrame, parts: int) -> DataFrame:
    """Spans of the contexts (h, rid, off, single, left, right) that stand alone, from the repeats of their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_runs(batches, ["h"]):
            right, nr = _padded(batch.column("right"), LEAST)
            left, nl = _padded(batch.column("left"), LEFT)
            rid, off, single = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "off", "single"))
            lcp = _reach(right[1:], right[:-1], nr[1:], nr[:-1])
            before, after = np.zeros(len(rid), np.int64), np.zeros(len(rid), np.int64)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]  # groups of two have one interval
            l = _reach(left[two], left[two + 1], nl[two], nl[two + 1])
            ok = (l + lcp[two] >= LEAST) & (lcp[two] >= GRAM)
            for k in (0, 1):
                before[two[ok] + k], after[two[ok] + k] = l[ok], lcp[two[ok]]
            for s, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                z = slice(s, s + n)
                before[z], after[z] = extents(right[z], nr[z], left[z], nl[z], lcp[s : s + n - 1])
            hit = single & (after > 0)
            yield pa.RecordBatch.from_arrays([pa.array(rid[hit]), pa.array((off - before)[hit]), pa.array((off + after)[hit])], ["rid", "start", "end"])

    dealt = contexts.select("h", "rid", "off", "single", "left", "right").repartition(parts, "h")
    return dealt.sortWithinPartitions("h", "right", "rid", "off").mapInArrow(run, SPANS)


def read_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted contexts; those of hot groups give the hashes of their windows (h) and where they start (off)."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "off", "l", "r", "single", "hot")).alias("at"))
    fields = [("hot", pa.bool_()), ("h", pa.int64()), ("rid", pa.int64()), ("off", pa.int64()), ("single", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_py().encode()
                for a in at:
                    lo, hi = a["off"] - a["l"], a["off"] + a["r"]
                    if not a["hot"]:
                        out.append((False, a["h"], rid, a["off"], a["single"], data[lo : a["off"]][::-1], data[a["off"] : hi]))
                        continue
                    part = np.frombuffer(data[lo:hi], np.uint8)
                    start = np.arange(len(part) - LEAST + 1)
                    for w, s in zip(_hash(prefix_hashes(part), powers(len(part) + 1)[1], start, start + LEAST).view(np.int64).tolist(), start.tolist(), strict=True):
                        out.append((True, w, rid, lo + s, True, None, None))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [f for f, _ in fields])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [f for f, _ in fields])

    return docs.join(lists, "rid").select("rid", "text", "at").mapInArrow(run, "hot boolean, h long, rid long, off long, single boolean, left binary, right binary")


def row_id() -> Column:
    return F.xxhash64("doc_id", "text")


def repeated_contexts(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Anchors of docs (rid, text) whose gram recurs, and their different contexts: (h, ctx, n, one of their places)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ws.write(anchor_rows(docs), "anchors")
    # dealt anew, so that both sides of a join are plain exchanges, which adaptive execution splits at a frequent hash
    again = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h").repartition(parts)
    rows = ws.write(found.join(again, "h", "left_semi"), "repeated")
    ws.drop(found)
    return rows, ws.write(rows.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("rid", "off", "l", "r")).alias("one")), "contexts")


def frequent_windows(bytes_: DataFrame, parts: int) -> DataFrame:
    """(h, rid, off) of the windows of hot groups that start at several places."""
    windows = bytes_.where("hot").select("h", "rid", "off").distinct()
    often = windows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h").repartition(parts)
    return windows.join(often, "h", "left_semi")


def repeat_spans(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(rid, start, end) of stretches that docs (rid, text) repeat; they overlap and touch."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, alike = repeated_contexts(docs, ws)
    whole = rows.where(F.col("l") + F.col("r") >= LEAST).join(alike.where("n > 1").select("h", "ctx"), ["h", "ctx"], "left_semi")
    whole = ws.write(whole.select("rid", (F.col("off") - F.col("l")).alias("start"), (F.col("off") + F.col("r")).alias("end")), "whole")
    groups = alike.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").repartition(parts)
    wanted = alike.join(groups.select("h", (F.col("kinds") > HOT).alias("hot")), "h").select("h", "one.*", (F.col("n") == 1).alias("single"), "hot")
    bytes_ = ws.write(read_contexts(docs, wanted), "bytes")
    ws.drop(rows, alike)
    spans = ws.write(group_spans(bytes_.where("not hot"), parts), "spans")
    hot = ws.write(frequent_windows(bytes_, parts).select("rid", F.col("off").alias("start"), (F.col("off") + LEAST).alias("end")), "windows")
    ws.drop(bytes_)
    return whole.union(spans).union(hot)


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(repeat, n_bytes, doc_id, start, end): each place in docs (doc_id, text) of each maximal repeat; repeat names its bytes.

    Contexts bound what is seen, LEFT bytes before an anchor and LEAST after it; a longer repeat comes as several. A repeated row
    lists its places again. Groups over HOT contexts give the windows of LEAST bytes that recur, which need no task for a group.
    Rows out are at most those of the anchors' intervals, which may be many more than anchors: this is the report, not the way to drop.
    """
    ws, parts = Workspace(docs.sparkSession, "repeats"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", row_id())
    rows, alike = repeated_contexts(docs, ws)
    large = ws.write(alike.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("h"), "large")
    fields = ["h", "rid", "off", "l", "r", "single", "hot"]
    some = alike.join(large, "h", "left_anti").select("h", "one.*", (F.col("n") == 1).alias("single"), F.lit(False).alias("hot")).select(fields)
    every = rows.join(large, "h", "left_semi").withColumns({"single": F.lit(True), "hot": F.lit(True)}).select(fields)
    texts = docs.select("rid", "text").dropDuplicates(["rid"])
    bytes_ = ws.write(read_contexts(texts, some.union(every)), "bytes")
    found = ws.write(group_repeats(bytes_.where("not hot"), parts), "found")
    at = alike.select("h", "ctx", F.col("one.rid").alias("rid"), F.col("one.off").alias("off"))
    named = found.join(at, ["h", "rid", "off"]).select("h", "ctx", "repeat", "before", "after")
    places = rows.select("h", "ctx", "rid", "off").join(named, ["h", "ctx"])
    places = places.select("repeat", "rid", (F.col("off") - F.col("before")).alias("start"), (F.col("off") + F.col("after")).alias("end"))
    copied = ws.write(docs.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid"), "copied")
    windows = frequent_windows(bytes_, parts).union(bytes_.where("hot").select("h", "rid", "off").join(copied, "rid", "left_semi").select("h", "rid", "off"))
    windows = windows.select(F.concat(F.lit("window-"), F.hex("h")).alias("repeat"), "rid", F.col("off").alias("start"), (F.col("off") + LEAST).alias("end"))
    places = ws.write(places.union(windows).distinct(), "places")
    ws.drop(rows, alike, large, bytes_, found, copied)
    return docs.select("rid", "doc_id").join(places, "rid").select("repeat", (F.col("end") - F.col("start")).alias("n_bytes"), "doc_id", "start", "end")


def removed(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): spans are the maximal removed runs in bytes, kept the remaining bytes."""
    ws = Workspace(docs.sparkSession, "substrings")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", row_id())
    lists = repeat_spans(docs, ws).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out: tuple[list, ...] = ([], [], [], [])
                for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    data = text.as_py().encode()
                    runs = removed([(s["start"], s["end"]) for s in spans or ()])
                    ends = [0, *(e for _, e in runs)]
                    kept = b"".join(data[e:s] for e, s in zip(ends, [*(s for s, _ in runs), len(data)], strict=True))
                    for column, x in zip(out, (doc_id, len(data), [{"start": s, "end": e} for s, e in runs], kept), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "spans", "kept"])

    return docs.join(lists, "rid", "left").select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(run, schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

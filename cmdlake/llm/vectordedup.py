"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated at random (three rounds of random signs and a fast Hadamard transform) and hashed to the
nearest of the 2d signed axes. Two such hashes make a bucket; TABLES tables are filled independently. A vector
is posted in its own bucket of each table and, as a visitor, in the PROBES next nearest ones. Pairs that meet,
at least one of them at home, are verified by cosine in double precision. A pair at cosine 0.95 meets nowhere
with probability 7e-6 in 64 dimensions.

Equal vectors are one class. A pair that meets in several buckets counts in the first one only, which both rows'
hashes tell. Buckets are compared in square blocks of bounded size; from each block go link counts per class and
a spanning forest of its links, never all pairs.

Postings carry a vector as it is stored, in single precision if it is, and its axes in four bytes each; comparisons are in double.

Vectors that are null, zero or hold null or non-finite components link with nothing and keep their own id.
Vectors of different length never link; repeated rows are links of each other; rows with a null vec_id take part,
a component's id is its smallest vec_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import whole_runs
from .common import Workspace, connected_components, table
from .vectors import matrices, unit, vectors

LEAST, TABLES, PROBES, BLOCK, SEED = 0.95, 9, 2, 1024, 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def nearest_axes(x: np.ndarray, signs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most nearest signed axes after rotation, nearest first, and how near they are."""
    for s in signs:
        x = hadamard(x * s)
    most = min(most, x.shape[1])
    axis = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :most]
    value = np.take_along_axis(x, axis, 1)
    return 2 * axis + (value < 0), np.abs(value)


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket keys: home first, then by how little worse the axes are."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - d)))
    rng, out = np.random.default_rng([seed, d]), np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        (a, va), (b, vb) = (nearest_axes(x, rng.choice([-1.0, 1.0], (3, size)), probes + 1) for _ in range(2))
        alone = [a[:, q] * 2 * size + b[:, 0] for q in range(1, a.shape[1])] + [a[:, 0] * 2 * size + b[:, q] for q in range(1, b.shape[1])]
        worse = [va[:, 0] - va[:, q] for q in range(1, a.shape[1])] + [vb[:, 0] - vb[:, q] for q in range(1, b.shape[1])]
        best = np.argsort(np.stack(worse, 1), axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(np.stack(alone, 1), best, 1)
        home = a[:, 0] * 2 * size + b[:, 0]
        out[:, t, 0] = home
        out[:, t, 1:] = home[:, None]
        out[:, t, 1 : 1 + found.shape[1]] = found
    return out + places(tables, d)


def places(tables: int, d: int) -> np.ndarray:
    """What sets the keys of different tables, and of vectors of different length, apart: high bits over those of the axes."""
    return ((np.arange(tables, dtype=np.int64) << 56) + (np.int64(d % (1 << 16)) << 40))[:, None]


def packed(keys: np.ndarray, d: int) -> list[bytes]:
    """The keys of each row of buckets without what their place tells: four bytes each, but for vectors that need more."""
    return [c.tobytes() for c in (keys - places(keys.shape[1], d)).astype(np.uint32 if d <= 1 << 15 else np.int64)]


def unpacked(column: pa.Array, d: np.ndarray) -> np.ndarray:
    """The keys of packed rows of vectors of lengths d."""
    out, raw = np.empty((len(d), TABLES, 1 + PROBES), np.int64), np.array(column.to_pylist(), object)
    for one in np.unique(d).tolist():
        rows = np.flatnonzero(d == one)
        some = np.frombuffer(b"".join(raw[rows]), np.uint32 if one <= 1 << 15 else np.int64)
        out[rows] = some.reshape(len(rows), TABLES, 1 + PROBES).astype(np.int64) + places(TABLES, one)
    return out


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first bucket, by table then key, in which rows with buckets a and b meet, one of them at home."""
    never = np.iinfo(np.int64).max
    at_a = np.where((b == a[:, :, :1]).any(2), a[:, :, 0], never)
    at_b = np.where((a == b[:, :, :1]).any(2), b[:, :, 0], never)
    return np.minimum(at_a, at_b).min(1)  # keys of earlier tables are smaller


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over links a, b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(after, at, low)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def hashed(nodes: DataFrame) -> DataFrame:
    """(node, codes, d) of nodes (node, v): all bucket keys, packed, and the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                codes = np.empty(some.num_rows, object)
                for rows, x in matrices(some.column(1)):
                    codes[rows] = packed(buckets(unit(x)), x.shape[1])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(codes, pa.binary()), some.column(1).value_lengths()], ["node", "codes", "d"])

    return nodes.select("node", "v").mapInArrow(run, "node long, codes binary, d int")


def posted(coded: DataFrame) -> DataFrame:
    """(key, node): each node under all its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                codes = unpacked(some.column(1), some.column(2).to_numpy()).reshape(some.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), pa.array(np.repeat(some.column(0).to_numpy(), codes.shape[1]))], ["key", "node"])

    return coded.mapInArrow(run, "key long, node long").distinct()


def _compare(key: int, i: int, j: int, node: np.ndarray, block: np.ndarray, n: np.ndarray, codes: np.ndarray, x: np.ndarray, least: float):
    """(node, links, low) arrays of one cell: low is the smallest node of its component within the cell."""
    home = (codes[:, :, 0] == key).any(1)
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    p, q = [], []
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        ok = (x[rows] @ x[right].T >= least - 1e-9) & (home[rows][:, None] | home[right][None])
        if i == j:
            ok &= rows[:, None] < right[None]
        u, v = np.nonzero(ok)
        if len(u):
            u, v = rows[u], right[v]
            sure = (x[u] * x[v]).sum(1) >= least
            u, v = u[sure], v[sure]
            first = first_meeting(codes[u], codes[v]) == key
            p.append(u[first])
            q.append(v[first])
    p, q = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (p, q))
    if not len(p):
        return None
    count = np.bincount(p, n[q], len(node)) + np.bincount(q, n[p], len(node))
    linked = np.flatnonzero(count)
    nodes, low = forest(node[p], node[q])
    return node[linked], count[linked].astype(np.int64), low[np.searchsorted(nodes, node[linked])]


def compare(wide: DataFrame, least: float, parts: int) -> DataFrame:
    """(node, links, low) of each cell (key, i, j) of wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_runs(batches, ["key", "i", "j"]):
            key, i, j, node, block, n = (batch.column(c).to_numpy() for c in ("key", "i", "j", "node", "block", "n"))
            lengths, values = batch.column("v").value_lengths().to_numpy(), batch.column("v").flatten().to_numpy().astype(np.float64)
            codes = unpacked(batch.column("codes"), lengths)
            ends = np.cumsum(lengths)
            out = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s > 1:
                    x = unit(values[ends[s] - lengths[s] : ends[e - 1]].reshape(e - s, -1))
                    if (found := _compare(key[s], i[s], j[s], node[s:e], block[s:e], n[s:e], codes[s:e], x, least)) is not None:
                        out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "links", "low"])

    dealt = wide.select("key", "i", "j", "node", "block", "n", "codes", "v").repartition(parts, "key", "i", "j")
    return dealt.sortWithinPartitions("key", "i", "j").mapInArrow(run, "node long, links long, low long")


def near_duplicates(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, embedding)."""
    ws = Workspace(rows.sparkSession, "vectors")
    classes = vectors(rows).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    again = F.row_number().over(W.partitionBy("rep", F.when(F.col("rep").isNull(), F.xxhash64("v"))).orderBy("v"))
    own = -F.pmod(F.xxhash64("v"), F.lit(1 << 62)) - (1 << 61)
    nodes = ws.write(classes.withColumn("node", F.when((again == 1) & F.col("rep").isNotNull(), F.col("rep")).otherwise(own)), "nodes")
    coded = ws.write(hashed(nodes), "codes")
    all_lists = ws.write(posted(coded), "lists")
    # a table of its own: adaptive execution splits a join's hot key only where both sides are plain
    sizes = ws.write(all_lists.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    lists = all_lists.join(sizes.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key")
    lists = lists.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = lists.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")
    stored = rows.schema["embedding"].dataType.simpleString()
    v = F.col("v").cast(stored if stored == "array<float>" else "array<double>").alias("v")
    wide = cells.join(coded.select("node", "codes"), "node").join(nodes.select("node", "n", v), "node")
    met = ws.write(compare(wide, least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "met")
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(ws, met.select(F.col("node").alias("a"), F.col("low").alias("b")), "cc")
    groups = nodes.join(counts, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = ws.write(groups.join(ids, "component").select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    ws.drop(all_lists, sizes, coded, nodes, met)
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_v")).join(named, "_v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gets a signature of SYMBOLS min-hashes, each cut to b = 16 bits. Signatures
are split into CHUNKS chunks of four symbols. Two signatures that differ in at most DISTANCE symbols agree,
by the pigeonhole principle, on some chunk up to one symbol; so posting each signature under every chunk with
each one of its symbols left out finds all pairs within DISTANCE. At similarity 0.75 a signature differs in 16
symbols on average, and in more than DISTANCE with probability 2e-5.

Documents with equal sets are one class and are compared once. First every class is compared with the smallest
one of each of its posting lists, its head: as many pairs as postings at most. The links found make components. A second round
compares, within each list, classes of different components, in square blocks of bounded size; rows of a
list's largest component meet the others only. A pair that shares several lists is compared in the first one.
Parity sketches, a few bits a shingle, tell in a first pass which rows of a block may have a partner: a bit is flipped by
each shingle that hashes to it, so two sketches differ in no more bits than their sets differ in shingles, and no
similar pair is lost. Those rows meet again with their whole sets, and each block gives a spanning forest of its links.
Both passes give at most the rows that they read, never pairs. All links are confirmed on sets of the words themselves.

Hashes of shingles have 64 bits, names of sets 128; a link that they propose wrongly fails on the words.

Null texts and texts without words have no shingle, stay alone and are kept; shorter texts are one shingle; texts are
taken whole however long; repeated rows are copies of each other; at similarity 0.75 exactly a pair is linked; rows with a
null doc_id join components, whose id is the smallest doc_id that is not null; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import flat, mix, shingles, slices, whole_runs
from .common import Workspace, connected_components, table

SYMBOLS, CHUNKS, DISTANCE = 64, 16, 31
IN_CHUNK = SYMBOLS // CHUNKS
PERCENT = 75
#: A block of the second round has about so many rows and bytes of sets at most.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
_FACTORS = mix(np.arange(1001, 1001 + SYMBOLS, dtype=np.uint64)) | np.uint64(1)


def _starts(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)


def set_hashes(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set, in two integers, for each run of rows."""
    with np.errstate(over="ignore"):
        return tuple(np.add.reduceat(mix(h + np.uint64(k)), starts).view(np.int64) if len(h) else np.zeros(0, np.int64) for k in (11, 12))


def signature(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(runs, SYMBOLS) of 16-bit symbols."""
    out = np.empty((len(starts), SYMBOLS), np.uint16)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(_FACTORS):
            out[:, k] = mix(np.minimum.reduceat(h * factor, starts)) >> np.uint64(48)
    return out


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity sketch of n shingles: a power of two, 64 at least, two to four for each shingle."""
    return np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64)))


def parities(h: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The parity sketch of each run of shingles."""
    n = np.diff(np.append(starts, len(h)))
    bits = sketch_bits(n)
    first = np.cumsum(bits) - bits
    at = np.repeat(first, n) + (mix(h).view(np.int64) & np.repeat(bits - 1, n))
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : (a + b) // 8] for a, b in zip(first.tolist(), bits.tolist(), strict=True)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n_shingles, c1, c2, sig, odd): t is a hash of the text, c1 and c2 name the set; sig and odd are null where it is empty."""
    names = ["doc_id", "t", "n_shingles", "c1", "c2", "sig", "odd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j, d, o in slices(data, offsets):
                row, h = shingles(d, o)
                n, (c1, c2) = np.bincount(row, minlength=j - i), np.zeros((2, j - i), np.int64)
                sig, odd = np.full(j - i, None, object), np.full(j - i, None, object)
                starts = _starts(row)
                if len(row):
                    full = row[starts]
                    c1[full], c2[full] = set_hashes(h, starts)
                    sig[full] = [x.tobytes() for x in signature(h, starts)]
                    odd[full] = parities(h, starts)
                cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(c1), pa.array(c2), pa.array(sig, pa.binary()), pa.array(odd, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, n_shingles long, c1 long, c2 long, sig binary, odd binary")


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def postings(nodes: DataFrame) -> DataFrame:
    """(key, node): every signature under each chunk with each of its symbols left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                s = _symbols(some.column(1)).astype(np.int64).reshape(-1, CHUNKS, IN_CHUNK)
                keys = []
                for left_out in range(IN_CHUNK):
                    a, b, c = (s[:, :, k] for k in range(IN_CHUNK) if k != left_out)
                    keys.append(((np.arange(CHUNKS) * IN_CHUNK + left_out) << 48) | (a << 32) | (b << 16) | c)
                keys = np.concatenate(keys, 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(some.column(0).to_numpy(), keys.shape[1]))], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def meetings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether within DISTANCE, the first list that both are posted in, by chunk and symbol left out) of signatures."""
    same = a == b
    per = same.reshape(len(same), CHUNKS, IN_CHUNK)
    agree = per.sum(2)
    chunk = (agree >= IN_CHUNK - 1).argmax(1)
    odd_one = per[np.arange(len(per)), chunk].argmin(1)  # 0 where all agree
    return agree.sum(1) >= SYMBOLS - DISTANCE, chunk * IN_CHUNK + odd_one


def head_pairs(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a list's head and another row of it whose signatures are within DISTANCE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                near = pa.array(meetings(_symbols(some.column(2)), _symbols(some.column(3)))[0])
                yield pa.RecordBatch.from_arrays([some.column(0).filter(near), some.column(1).filter(near)], ["a", "b"])

    pairs = met.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def planes(sigs: np.ndarray) -> np.ndarray:
    """Three bit planes of the symbols: their differences, or-ed, have a bit for each symbol that surely differs."""
    weights = np.uint64(1) << np.arange(SYMBOLS, dtype=np.uint64)
    return np.stack([(((sigs >> p) & 1).astype(np.uint64) * weights).sum(1, dtype=np.uint64) for p in range(3)])


def may_be_similar(differ: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False only for sets of sizes n and m that are not similar, if they differ in at least differ shingles."""
    total = n + m
    # intersection = (total - difference) / 2, union = (total + difference) / 2
    return (100 * (total - differ) >= PERCENT * (total + differ)) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))


class Sketches:
    """Parity sketches of rows, comparable across sizes: a longer one folds, half on half, to a shorter one's size."""

    def __init__(self, odd: list[bytes]):
        size = np.array([len(x) for x in odd])
        self.level, self.at, self.held = size, np.zeros(len(odd), np.int64), {}
        for s in np.unique(size).tolist():
            rows = np.flatnonzero(size == s)
            self.at[rows] = np.arange(len(rows))
            self.held[s] = np.frombuffer(b"".join(odd[r] for r in rows), np.uint64).reshape(len(rows), -1)

    def folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        own = int(self.level[rows[0]])
        x = self.held[own][self.at[rows]]
        while own > size:
            own //= 2
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return x

    def differences(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows p and q differ, at the size of the shorter."""
        out, a, b = np.zeros(len(p), np.int64), self.level[p], self.level[q]
        for x, y in {*zip(a.tolist(), b.tolist(), strict=True)}:
            mine, size = np.flatnonzero((a == x) & (b == y)), min(x, y)
            step = max(1, (1 << 23) // size)
            for s in range(0, len(mine), step):
                some = mine[s : s + step]
                out[some] = np.bitwise_count(self.folded(p[some], size) ^ self.folded(q[some], size)).sum(1, dtype=np.int64)
        return out


def candidates(slot: int, first: np.ndarray, second: np.ndarray, component: np.ndarray, n: np.ndarray, head: np.ndarray, sigs: np.ndarray, odd: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, one of first and one of second, that may be similar and that this list is the first to hold."""
    plane, sketches = planes(sigs), Sketches(odd)
    first, second = first[~head[first]], second[~head[second]]  # pairs with the head are compared before
    for at in range(0, len(first), 256):
        rows = first[at : at + 256]
        differ = np.zeros((len(rows), len(second)), np.uint64)
        for p in plane:
            differ |= p[rows][:, None] ^ p[second][None]
        x, y = np.nonzero((np.bitwise_count(differ) <= DISTANCE) & (component[rows][:, None] != component[second][None]))
        for s in range(0, len(x), 1 << 16):
            p, q = rows[x[s : s + (1 << 16)]], second[y[s : s + (1 << 16)]]
            fit = may_be_similar(np.zeros(len(p), np.int64), n[p], n[q])
            p, q = p[fit], q[fit]
            near, place = meetings(sigs[p], sigs[q])
            p, q = p[near & (place == slot)], q[near & (place == slot)]
            if len(p):
                fit = may_be_similar(sketches.differences(p, q), n[p], n[q])
                if fit.any():
                    yield p[fit], q[fit]


def _sides(i: int, j: int, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows to compare in a cell: one block with another, or the two halves of a block and each half in itself."""
    left = np.flatnonzero(block == i)
    if i != j:
        yield left, np.flatnonzero(block == j)
        return
    stack = [left]
    while stack:
        rows = stack.pop()
        if len(rows) > 1:
            a, b = rows[: len(rows) // 2], rows[len(rows) // 2 :]
            yield a, b
            stack += [a, b]


CELL = ["key", "i", "j", "block", "node", "component", "is_head", "n_shingles", "sig"]
CELLS = "key long, i int, j int, block int, node long, component long, is_head boolean, n_shingles long, sig binary"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch, bounds in whole_runs(batches, ["key", "i", "j"]):
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s > 1:
                cell = batch.slice(int(s), int(e - s))
                key, i, j, block, node, component, head, n = (cell.column(c).to_numpy(zero_copy_only=False) for c in CELL[:-1])
                yield cell, int(key[0]) >> 48, int(i[0]), int(j[0]), block, node, component, head, n, _symbols(cell.column("sig"))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def hopeful_rows(rows: DataFrame, parts: int) -> DataFrame:
    """The rows of cells (CELL and odd) that have a partner that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, slot, i, j, block, _, component, head, n, sigs in _cells(batches):
            odd, hit = cell.column("odd").to_pylist(), np.zeros(len(n), bool)
            for first, second in _sides(i, j, block):
                for p, q in candidates(slot, first, second, component, n, head, sigs, odd):
                    hit[p] = hit[q] = True
            if hit.any():
                yield cell.select(CELL).filter(pa.array(hit))

    return _dealt(rows.select(*CELL, "odd"), parts).mapInArrow(run, CELLS)


def block_links(rows: DataFrame, parts: int) -> DataFrame:
    """Links (a, b), a spanning forest for each cell of rows (CELL and shingles), from whole sets."""

    def links(slot, i, j, block, node, component, head, n, sigs, sets) -> tuple[list[int], list[int]]:
        starts = np.cumsum(n) - n
        odd, (_, place) = parities(sets, starts), np.unique(sets, return_inverse=True)
        label, held, a, b = component.copy(), np.zeros(len(sets), bool), [], []
        for first, second in _sides(i, j, block):
            for p, q in candidates(slot, first, second, component, n, head, sigs, odd):
                order = np.argsort(p, kind="stable")
                p, q = p[order], q[order]
                for s, e in zip(_starts(p), np.append(_starts(p)[1:], len(p)), strict=True):
                    x = p[s]
                    others = q[s:e][label[q[s:e]] != label[x]]
                    mine = place[starts[x] : starts[x] + n[x]]
                    held[mine] = True
                    for k in range(0, len(others), 256):
                        some = others[k : k + 256]
                        size = n[some]
                        first_of = np.cumsum(size) - size
                        at = np.arange(size.sum()) - np.repeat(first_of - starts[some], size)
                        common = np.add.reduceat(held[place[at]], first_of, dtype=np.int64)
                        for y in some[100 * common >= PERCENT * (n[x] + size - common)].tolist():
                            if label[y] != label[x]:
                                a.append(int(node[x]))
                                b.append(int(node[y]))
                                label[label == label[y]] = label[x]
                    held[mine] = False
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, *facts in _cells(batches):
            sets = np.frombuffer(b"".join(cell.column("shingles").to_pylist()), np.uint64)
            a, b = links(*facts, sets)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _dealt(rows.select(*CELL, "shingles"), parts).mapInArrow(run, "a long, b long")


def cells(ws: Workspace, met: DataFrame, labelled: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Rows of lists that hold several components, in cells (key, i, j); those of a list's largest component meet the others only."""
    rows = met.where("n > 2").join(labelled, "node")
    comps = rows.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    lists = comps.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("m", "w", "component")).alias("most"), F.sum("m").alias("m"), F.sum("w").alias("w")).where("kinds > 1")

    def blocks(m, w):
        return F.greatest(F.ceil(m / block), F.ceil(w * 8 / block_bytes)).cast("int")

    lists = lists.select("key", F.col("most.component").alias("largest"), blocks(F.col("most.m"), F.col("most.w")).alias("own"), blocks(F.col("m") - F.col("most.m"), F.col("w") - F.col("most.w")).alias("others"))
    rows = rows.join(ws.write(lists, "several"), "key").withColumn("in_largest", F.col("component") == F.col("largest"))
    place = F.xxhash64("node")
    rows = rows.withColumn("block", F.when(F.col("in_largest"), F.col("others") + F.pmod(place, "own")).otherwise(F.pmod(place, "others")).cast("int"))
    last = F.when(F.col("in_largest"), F.col("others")).otherwise(F.col("others") + F.col("own")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", (F.col("node") == F.col("head")).alias("is_head"), "n_shingles")


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) for wanted classes: the text of their first document."""
    mine = wanted.join(nodes.select("node", F.col("t").alias("own"), F.col("rep").alias("first_id"), "c1", "c2"), "node")
    rows = docs.join(mine, F.col("t").eqNullSafe(F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "c1", "c2", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text has the class's set: another text of that doc_id may have the text's hash."""
        for batch in batches:
            data, offsets = flat(batch.column(3))
            for i, j, d, o in slices(data, offsets):
                row, h = shingles(d, o)
                ok, starts = np.zeros(j - i, bool), _starts(row)
                if len(row):
                    c1, c2 = set_hashes(h, starts)
                    full = row[starts]
                    ok[full] = (batch.column(1).to_numpy()[i:j][full] == c1) & (batch.column(2).to_numpy()[i:j][full] == c2)
                some = batch.slice(i, j - i).filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(3)], ["node", "text"])

    return rows.mapInArrow(own, "node long, text string").dropDuplicates(["node"])


def shingles_of(texts: DataFrame) -> DataFrame:
    """(node, shingles): the hashes of a text's set, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j, d, o in slices(data, offsets):
                row, h = shingles(d, o)
                ends, raw = np.cumsum(np.bincount(row, minlength=j - i)).tolist(), h.tobytes()
                sets = [raw[8 * s : 8 * e] for s, e in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def word_shingles(text: str, size: int = 5) -> set[tuple[bytes, ...]]:
    """The shingles themselves; white space of ASCII parts words and A-Z count as a-z."""
    w = text.encode().lower().split()
    return set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else {tuple(w)} if w else set()


def similar(a: set, b: set) -> bool:
    common = len(a & b)
    return bool(a) and 100 * common >= PERCENT * (len(a) + len(b) - common)


def confirm(ws: Workspace, pairs: DataFrame, nodes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are similar on full sets of words."""
    pairs = ws.write(pairs, f"{name}-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = ws.write(texts_of(wanted, nodes, docs), f"{name}-texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, its = None, set()
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if a != one:
                    one, its = a, word_shingles(x.as_py())
                ok[k] = similar(its, word_shingles(y.as_py()))
            some = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], ["a", "b"])

    b_first = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = b_first.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    links = ws.write(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), f"{name}-links")
    ws.drop(texts, pairs)
    return links


def near_duplicates(docs: DataFrame, label: str = "neardup") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ws, parts = Workspace(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    all_sigs = ws.write(signatures(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t")).alias("first")
    classes = all_sigs.where("n_shingles > 0").groupBy("c1", "c2").agg(first, F.first("sig").alias("sig"), F.first("odd").alias("odd"), F.first("n_shingles").alias("n_shingles"))
    classes = classes.select("c1", "c2", F.col("first.doc_id").alias("rep"), F.col("first.t").alias("t"), "sig", "odd", "n_shingles")
    # a class goes by its smallest doc_id, or by a negative number if another class has that already
    again = F.row_number().over(W.partitionBy("rep", F.when(F.col("rep").isNull(), F.col("c1"))).orderBy("c1", "c2"))
    own = -F.pmod(F.xxhash64("c1", "c2"), F.lit(1 << 62)) - (1 << 61)
    nodes = ws.write(classes.withColumn("node", F.when((again == 1) & F.col("rep").isNotNull(), F.col("rep")).otherwise(own)), "nodes")
    sigs = ws.write(all_sigs.select("doc_id", "n_shingles", "c1", "c2"), "rows")
    ws.drop(all_sigs)

    heads = ws.write(postings(nodes).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "heads")
    met = ws.write(postings(nodes).join(heads, "key").select("key", "node", "head", "n"), "met")
    links = confirm(ws, head_pairs(met, nodes), nodes, docs, "first")
    labels = connected_components(ws, links, "cc-first")

    labelled = nodes.select("node", "n_shingles").join(labels, "node", "left").select("node", "n_shingles", F.coalesce("component", "node").alias("component"))
    dealt = cells(ws, met, ws.write(labelled, "labelled"), BLOCK, BLOCK_BYTES)
    hopeful = ws.write(hopeful_rows(dealt.join(nodes.select("node", "sig", "odd"), "node"), parts), "hopeful")
    ws.drop(met, heads)
    texts = texts_of(hopeful.select("node").distinct(), nodes, docs)
    sets = ws.write(shingles_of(texts), "sets")
    links2 = confirm(ws, block_links(hopeful.join(sets, "node"), parts).distinct(), nodes, docs, "second")
    ws.drop(hopeful, sets)
    # components of components
    over, to = links2, labels.select(F.col("node").alias("x"), F.col("component").alias("cx"))
    for c in ("a", "b"):
        over = over.join(to, F.col(c) == F.col("x"), "left").withColumn(c, F.coalesce("cx", c)).drop("x", "cx")
    merged = connected_components(ws, over, "cc-second")
    groups = nodes.select("node", "rep", "c1", "c2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = groups.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    groups = groups.select("c1", "c2", "rep", F.coalesce("top", "component").alias("top"))
    ids = groups.groupBy("top").agg(F.min("rep").alias("component_id")).repartition(parts)
    named = ws.write(groups.join(ids, "top").select("c1", "c2", "component_id"), "named")
    ws.drop(nodes, links, links2, labels, merged)
    out = sigs.join(named, ["c1", "c2"], "left")
    own_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), F.coalesce(F.col("doc_id") == own_id, F.lit(False)).alias("kept"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each component: the rows with its smallest doc_id; equal rows of one doc_id count once.

    Rows without a doc_id stay: nothing names them as a copy to remove.
    """
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    row = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("same"), F.struct("*").alias("row"))
    rows = row.where("doc_id is not null").join(kept, "doc_id", "left_semi").groupBy("doc_id", "same").agg(F.first("row").alias("row"))
    return rows.select("row").unionByName(row.where("doc_id is null").select("row")).select("row.*")

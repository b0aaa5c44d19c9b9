"""Language-model scores by masked pseudo-likelihood.

A small network sees the two words before and the two after a masked one and predicts it; a document's score is
the sum of the conditional log-probabilities of all its words. Words are lower-cased runs without white space.
The FREQUENT commonest, counted over all documents, are classes of their own, the rest fall into RARE classes by a hash
of their first two bytes; PAD stands outside a document. The softmax has two steps, a class's group of 32 and the class in it,
so a prediction costs 40 exponentials instead of 256.

A word's probability is that of its class between its context words, times its own within the class: the KNOWN commonest
words have their share of the class by count over all documents; what is left goes to other words by spelling, the
first two bytes by their share, then each byte, and the word's end, given the two bytes before, as counted
over all such words. Over all words a class's shares sum to one, so each word has a probability of its own.

Training is data parallel: documents are dealt by a hash of their text and id into as many shards as their number of
words asks for. In each of ROUNDS rounds every shard starts from the shared weights and runs minibatch gradient descent
in NumPy over every window of its documents, in the order of that hash; the weights are averaged by windows seen,
in the order of shards. So the answer depends on the documents alone, not on files or tasks. What is read and gathered
grows with the corpus; the network, under 64 KB, does not. The spelling counts grow with the kinds of three
bytes in a row, 2^24 at most.

Null and empty texts have no words, sum 0.0 and no mean; short texts see PAD on both sides; texts are scored whole however
long; equal texts get equal scores, as all blocks of windows have one shape; extra columns are ignored, whatever their
names; rows with a null doc_id are scored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import _LOWER, flat, mix, slices, word_bounds, words
from .common import Workspace, table

FREQUENT, RARE, PAD = 191, 64, 255
KNOWN = 1 << 16
VOCABULARY, GROUP, SIDE, WIDTH, HIDDEN = 256, 32, 2, 16, 32
GROUPS = VOCABULARY // GROUP
ROUNDS, BATCH, RATE = 2, 2048, 0.1
#: Words of a shard, and the most shards; windows scored at once.
SHARD, MOST_SHARDS, SCORED = 1 << 19, 4096, 4096
PIECES = 8
END = 32  # white space, which no word holds, stands before and after each
_CLASS = (FREQUENT + mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(RARE)).astype(np.uint8)


class Network:
    """Embeddings of 2 x SIDE words, a hidden layer of tanh units, a softmax over groups and one within each."""

    SHAPES = ((VOCABULARY, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, GROUP), (GROUPS, GROUP))

    def __init__(self, weights: np.ndarray | None = None, seed: int = 5):
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        if weights is None:
            rng, parts = np.random.default_rng(seed), []
            for k, n in enumerate(sizes):
                scale = (0.3, (2 * SIDE * WIDTH) ** -0.5, 0, HIDDEN**-0.5, 0, HIDDEN**-0.5, 0)[k]
                parts.append(rng.normal(size=n) * scale)
            weights = np.concatenate(parts)
        self.weights = np.array(weights, np.float32)
        parts = np.split(self.weights, np.cumsum(sizes)[:-1])
        self.embed, self.w1, self.b1, self.wg, self.bg, self.w2, self.b2 = (p.reshape(s) for p, s in zip(parts, self.SHAPES, strict=True))

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed.take(context, 0).reshape(len(context), -1)
        h = x @ self.w1
        h += self.b1
        return x, np.tanh(h, out=h)

    def shift(self) -> bool:
        """Whether an exponential might overflow: units are at most 1, so weights bound what goes into it."""
        return any(np.abs(w).sum(-2).max() + np.abs(b).max() > 60 for w, b in ((self.wg, self.bg), (self.w2, self.b2)))

    @staticmethod
    def softmax(z: np.ndarray, shift: bool) -> np.ndarray:
        if shift:
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z *= 1 / (z @ np.ones((z.shape[1], 1), np.float32))
        return z

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target between its context words, in blocks of one shape, so that a window's place doesn't tell."""
        n = len(target)
        if short := -n % SCORED:
            context = np.concatenate([context, np.full((short, context.shape[1]), PAD, np.uint8)])
            target = np.concatenate([target, np.full(short, PAD, np.uint8)])
        out, row, shift = np.empty(len(target)), np.arange(SCORED), self.shift()
        flat_w2 = np.ascontiguousarray(self.w2.transpose(1, 0, 2).reshape(HIDDEN, VOCABULARY))
        for s in range(0, len(target), SCORED):
            t = target[s : s + SCORED].astype(np.intp)
            _, h = self.hidden(context[s : s + SCORED])
            group = self.softmax(h @ self.wg + self.bg, shift)[row, t // GROUP]
            within = (h @ flat_w2).reshape(SCORED, GROUPS, GROUP)[row, t // GROUP] + self.b2[t // GROUP]
            own = self.softmax(within, shift)[row, t % GROUP]
            out[s : s + SCORED] = np.log(np.maximum(group * own.astype(np.float64), 1e-60))
        return out[:n]

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability, in the order of SHAPES."""
        order = np.argsort(target, kind="stable")  # a group's windows stand together
        context, target = context[order], target[order]
        one, (x, h), shift = np.float32(1 / len(target)), self.hidden(context), self.shift()
        group = target // GROUP
        p = self.softmax(h @ self.wg + self.bg, shift)
        p[np.arange(len(p)), group] -= 1
        p *= one
        dh, w2, b2 = p @ self.wg.T, np.zeros_like(self.w2), np.zeros_like(self.b2)
        bounds = np.searchsorted(group, np.arange(GROUPS + 1))
        for g in range(GROUPS):
            s, e = bounds[g], bounds[g + 1]
            if e > s:
                q = h[s:e] @ self.w2[g]
                q += self.b2[g]
                q = self.softmax(q, shift)
                q[np.arange(e - s), target[s:e] % GROUP] -= 1
                q *= one
                w2[g], b2[g] = h[s:e].T @ q, q.sum(0)
                dh[s:e] += q @ self.w2[g].T
        wg, bg = h.T @ p, p.sum(0)
        dh *= 1 - h * h
        embed = np.zeros_like(self.embed)
        around = context.ravel()
        order = np.argsort(around, kind="stable")
        found = around[order]
        first = np.flatnonzero(np.diff(found, prepend=found[0] ^ 1))
        embed[found[first]] = np.add.reduceat((dh @ self.w1.T).reshape(-1, WIDTH).take(order, 0), first, axis=0)
        return [embed, x.T @ dh, dh.sum(0), wg, bg, w2, b2]

    def train(self, context: np.ndarray, target: np.ndarray, squares: np.ndarray) -> None:
        """One pass in minibatches, with AdaGrad's step sizes; squares holds its sums."""
        for at in range(0, len(target), BATCH):
            g = np.concatenate([x.ravel() for x in self.gradients(context[at : at + BATCH], target[at : at + BATCH])])
            squares += g * g
            self.weights -= RATE * g / (np.sqrt(squares) + 1e-6)


def windows(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(len(ids), 2 x SIDE) ids around each place, PAD outside its row."""
    row = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    padded = np.full(len(ids) + SIDE * (len(offsets) + 1), PAD, np.uint8)
    at = np.arange(len(ids)) + SIDE * row
    padded[at] = ids
    return np.stack([padded[at + step] for step in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1)


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the FREQUENT commonest words of all documents; sorted hashes and counts of the KNOWN next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            found = [words(d, o)[0] for _, _, d, o in slices(data, offsets)]
            if found:
                word, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT + KNOWN).toArrow()
    word, n = top.column("word").to_numpy(), top.column("n").to_numpy()
    rank = np.lexsort((word, -n))
    known = rank[FREQUENT:][np.argsort(word[rank[FREQUENT:]])]
    return np.sort(word[rank[:FREQUENT]]), word[known], n[known]


def places(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Each hash's place in the sorted held ones, -1 where it isn't among them."""
    signed = hashes.view(np.int64)
    if not len(held):
        return np.full(len(signed), -1)
    at = np.minimum(np.searchsorted(held, signed), len(held) - 1)
    return np.where(held[at] == signed, at, -1)


def identified(d: np.ndarray, o: np.ndarray, frequent: np.ndarray, known: np.ndarray):
    """(ids, place among known or -1, words in each row, start and end of each word) of lower-cased rows."""
    hashes, counts = words(d, o, lower=False)
    s, e = word_bounds(d, o) if len(d) else (np.zeros(0, np.int64),) * 2
    second = np.where(e - s > 1, d[np.minimum(s + 1, len(d) - 1)], END) if len(s) else s
    own, at = _CLASS[d[s].astype(np.int64) * 256 + second], places(hashes, frequent)
    ids, named = np.where(at >= 0, at, own).astype(np.uint8), np.full(len(s), -1)
    rare = np.flatnonzero(at < 0)
    named[rare] = places(hashes[rare], known)
    return ids, named, counts, s, e


def spelled(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of three bytes in a row, first code of each word): a word's bytes and END, two ENDs before them."""
    size = e - s + 1
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first, size)
    byte = d[np.minimum(np.repeat(s, size) + at, len(d) - 1)].astype(np.uint32)
    byte[first + size - 1] = END
    codes = byte.copy()
    codes[1:] |= np.where(at[1:] > 0, byte[:-1], END).astype(np.uint32) << 8
    codes[2:] |= np.where(at[2:] > 1, byte[:-2], END).astype(np.uint32) << 16
    codes[0] |= END << 8 | END << 16
    codes[1] |= END << 16  # a word has two codes at least
    return codes, first


def spelling_counts(docs: DataFrame, frequent: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, n) over all documents: three bytes in a row in words that aren't known, and behind these codes the words of each class."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << 24) + VOCABULARY, np.int64)  # only the pages of codes that occur take memory
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for _, _, d, o in slices(data, offsets):
                d = _LOWER[d]
                ids, named, _, s, e = identified(d, o, *shared.value)
                held[1 << 24 :] += np.bincount(ids, minlength=VOCABULARY)
                rare = np.flatnonzero((ids >= FREQUENT) & (named < 0))
                if len(rare):
                    code, n = np.unique(spelled(d, s[rare], e[rare])[0], return_counts=True)
                    held[code] += n
        code = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(held[code], pa.int64())], ["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return rows.column("code").to_numpy(), rows.column("n").to_numpy()


def spelling(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability by code: of a byte after two, and of a word's second byte, with the first, within its class; words of each class)."""
    sizes = np.zeros(VOCABULARY)
    sizes[code[code >= 1 << 24] - (1 << 24)] = n[code >= 1 << 24]
    code, n = code[code < 1 << 24], n[code < 1 << 24]
    two, last = code >> 8, code & 255
    start, second = two == (END << 8 | END), (two >> 8 == END) & (two & 255 != END)
    kind = _CLASS[(two & 255) * 256 + last].astype(np.int64)
    given = np.where(second, (1 << 16) + kind, two)
    total = np.bincount(given, n, (1 << 16) + VOCABULARY)
    out = np.zeros(1 << 24, np.float32)
    # the second byte's share is of all the class's words, known ones too
    out[code] = np.where(start, 0, np.log(n / np.maximum(np.where(second, sizes[kind], total[given]), 1)))
    return out, sizes


def tokenized(docs: DataFrame, terms: tuple[np.ndarray, np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, place, ids, own): a byte per word, and the words' log-probability within their classes; place orders documents at random."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (frequent, known, often), counted = shared.value
        logs, sizes = spelling(*counted)
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j, d, o in slices(data, offsets):
                d = _LOWER[d]
                found, named, n, s, e = identified(d, o, frequent, known)
                ids, ends = found.tobytes(), np.cumsum(n)
                rows = [ids[s:e] for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                word = np.zeros(len(found))
                at = np.flatnonzero(named >= 0)
                word[at] = np.log(often[named[at]] / sizes[found[at]])
                rare = np.flatnonzero((found >= FREQUENT) & (named < 0))
                if len(rare):
                    codes, first = spelled(d, s[rare], e[rare])
                    word[rare] = np.add.reduceat(logs[codes], first, dtype=np.float64)
                own = np.bincount(np.repeat(np.arange(j - i), n), word, j - i).astype(np.float64)  # of nothing it counts in integers
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(rows, pa.binary()), pa.array(own)], ["doc_id", "place", "ids", "own"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.col("doc_id").cast("long")).alias("place"), "text")
    return rows.mapInArrow(run, "doc_id long, place long, ids binary, own double")


def dealt(tokens: DataFrame) -> DataFrame:
    """tokens with shard, a partition for each; their number follows the number of words."""
    total = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    shards = int(min(MOST_SHARDS, max(1, -(-total // SHARD))))
    return tokens.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))


def train_shard(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(shard, windows seen, weights) of the shards in sorted batches (shard, ids). Minibatches are cut by windows, wherever batches end."""
    net, seen, now, held = None, 0, None, []

    def pieces() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            shard = batch.column(0).to_numpy()
            data, offsets = flat(batch.column(1))
            for i, j, ids, o in slices(data, offsets, 1 << 19):
                first = np.flatnonzero(np.diff(shard[i:j], prepend=-1))
                for s, e in zip(first, [*first[1:], j - i], strict=True):
                    part = ids[o[s] : o[e]]
                    yield int(shard[i + s]), windows(part, o[s : e + 1] - o[s]), part

    def rest() -> Iterator[tuple[int, int, np.ndarray]]:
        if now is not None:
            context, target = (np.concatenate(x) for x in zip(*held, strict=True))
            net.train(context, target, squares)
            if seen:
                yield now, seen, net.weights

    for shard, context, target in pieces():
        if shard != now:
            yield from rest()
            net, squares, seen, now, held = Network(weights), np.full(len(weights), 1e-3, np.float32), 0, shard, []
        held.append((context, target))
        seen += len(target)
        if sum(len(t) for _, t in held) >= BATCH:
            context, target = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = len(target) // BATCH * BATCH
            net.train(context[:whole], target[:whole], squares)
            held = [(context[whole:], target[whole:])]
    yield from rest()


def train_round(tokens: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Weights after every shard has trained on its documents, averaged by windows seen in the order of shards."""
    size = -(-len(weights) // PIECES)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, seen, found in train_shard(batches, weights):
            parts = [found[k * size : (k + 1) * size].tobytes() for k in range(PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([shard] * PIECES, pa.int32()), pa.array([seen] * PIECES, pa.int64()), pa.array(parts, pa.binary())], ["piece", "shard", "seen", "weights"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for piece, seen, w in zip(batch.column("piece").to_pylist(), batch.column("seen").to_pylist(), batch.column("weights"), strict=True):
                w = np.frombuffer(w.as_py(), np.float32).astype(np.float64) * seen
                total, out = sums.get(piece, (0, 0.0))
                sums[piece] = total + seen, out + w
        pieces = sorted(sums)
        means = [(sums[k][1] / sums[k][0]).astype(np.float32).tobytes() for k in pieces]
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(means, pa.binary())], ["piece", "weights"])

    ordered = tokens.sortWithinPartitions("shard", "place", "doc_id", "ids").select("shard", "ids")
    made = ordered.mapInArrow(local, "piece int, shard int, seen long, weights binary")
    pieces = made.repartition(PIECES, "piece").sortWithinPartitions("piece", "shard").mapInArrow(average, "piece int, weights binary").collect()
    if not pieces:
        return weights
    return np.frombuffer(b"".join(r["weights"] for r in sorted(pieces, key=lambda r: r["piece"])), np.float32)


def score(tokens: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, logp_sum, logp_mean) of each row of tokens (doc_id, ids, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j, ids, o in slices(data, offsets, 1 << 18):
                p = np.append(net.log_probs(windows(ids, o), ids), 0.0)
                n = np.diff(o)
                total = np.where(n > 0, np.add.reduceat(p, o[:-1]), 0.0) + batch.column(2).slice(i, j - i).to_numpy()
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(total), mean], ["doc_id", "n_tokens", "logp_sum", "logp_mean"])

    return tokens.select("doc_id", "ids", "own").mapInArrow(run, "doc_id long, n_tokens long, logp_sum double, logp_mean double")


def masked_scores(docs: DataFrame) -> DataFrame:
    ws = Workspace(docs.sparkSession, "lmscore")
    terms = vocabulary(docs)
    tokens = ws.write(tokenized(docs, terms, spelling_counts(docs, *terms[:2])), "tokens")
    tokens, weights = dealt(tokens), Network().weights
    for _ in range(ROUNDS):
        weights = train_round(tokens, weights)
    return score(tokens, weights)


def op9_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_scores(table(spark, sf_dir, "documents"))

"""Best-fit packing of token sequences: bounded-space online best-fit.

Pieces stream through a packer that keeps a fixed number of open bins, found by a bitset keyed by
free space: the fullest open bin that still takes the piece gets it. When all places are taken, the
fullest bin closes. Pieces reach a packer largest first, which is the order best-fit likes.

Null texts count as empty: such a document is its end token alone; texts are taken whole however long, and cut into
pieces only by length in tokens; equal rows are packed one by one, and among pieces of equal length the order is by
doc_id, piece and content; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

MAX_TOKENS = 1024
END_ID = 2
OPEN_BINS = 4096
CACHE_WORDS = 400_000

_EDGE = re.compile(r"\s | \s")
#: The shortcut's pattern goes back over white space place by place, and its stack ends at some 100,000 of them.
_LONG_SPACE = re.compile(r"\s{10000}")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to the tokenizer file's own.

    The vocabulary's pre-tokenizer never joins text across a single space between two non-space
    characters, so such stretches are encoded one by one and remembered. Texts with other white space
    at those places go through the same ranks whole, and those with a special token's string or a very long run
    of white space through the tokenizer file.
    """

    def __init__(self, path: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        ranks_path = re.sub(r"\.json$", ".tiktoken", path)
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        try:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        except FileNotFoundError:  # a vocabulary without a file of ranks
            self.fast = None
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = np.array(outer.fast.encode_ordinary(" " + word), "<u4").tobytes()
                if len(word) <= 40:
                    if len(self) >= CACHE_WORDS:
                        self.clear()
                    self[word] = ids
                return ids

        self.words = Words()

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or _LONG_SPACE.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text or text[0] == " " or text[-1] == " " or _EDGE.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.fast.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than most."""
    first = n % most or min(n, most)
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


class BestFit:
    """Bounded-space online best-fit over bins of one capacity."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.next_id = 0, 0, 0

    def _put(self, bin_id: int, free: int) -> None:
        self.by_free[free].append(bin_id)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to capacity tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.places:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_id, self.next_id = self.capacity, self.next_id, self.next_id + 1
        left = free - length
        if left:
            self._put(bin_id, left)
        return bin_id, self.capacity - free


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, most: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: its ids, then end_id, cut where longer than most."""
    end = np.array([end_id], "<u4").tobytes()

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, most)):
                    for column, x in zip(out, (doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(pieces: DataFrame, most: int = MAX_TOKENS, places: int = OPEN_BINS) -> DataFrame:
    """pieces with sequence_id and offset. Packers work side by side on pieces dealt out by hash."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = TaskContext.get().partitionId() << 40, BestFit(most, places)
        for batch in batches:
            placed = [bins.add(n) for n in batch.column("length").to_pylist()]
            ids = pa.array([base + b for b, _ in placed], pa.int64())
            at = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, at], [*batch.schema.names, "sequence_id", "offset"])

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32"))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_fit_packing(docs: DataFrame, path: str | None = None, most: int = MAX_TOKENS) -> DataFrame:
    return pack(token_pieces(docs, path or tokenizer_path(), most), most)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))

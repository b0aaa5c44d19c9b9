"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts of variable order, up to two bytes, holds counts. A byte seen in
its context costs -log2(count / (total + kinds)); otherwise an escape costs -log2(kinds / (total + kinds))
and the next shorter context is asked, down to a uniform code. The statistics are frozen after learning, so
all code lengths are tabulated and a text's exact length is a sum of table entries. The shortest code names
the language; the score is its share of the probability.

Learning counts every labelled row, except those held out: all byte values, all languages.

Null texts and texts without a letter give ``und`` and 0.0, as do all texts when nothing is labelled; rows
without a label are scored but not learned from; texts are read whole however long; equal texts get equal answers; ties go to
the smaller language name; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import flat, slices
from .common import ship, table

HELD_OUT = 2
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def contexts(symbols: np.ndarray, offsets: np.ndarray, base: int, blank: int) -> np.ndarray:
    """Codes of (two bytes before, byte before, byte) in one integer; before a row's start stands blank."""
    s = symbols.astype(np.int64)
    one, two = np.full(len(s), blank, np.int64), np.full(len(s), blank, np.int64)
    one[1:], two[2:] = s[:-1], s[:-2]
    starts = offsets[:-1][np.diff(offsets) > 0]
    one[starts] = two[starts] = blank
    second = starts + 1
    second = second[second < len(s)]
    second = second[~np.isin(second, starts)]
    two[second] = blank
    return (two * base + one) * base + s


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text): three bytes in a row, combined in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column(1))
            for i, j, d, o in slices(data, offsets):
                if not len(d):
                    continue
                codes = contexts(d, o, 256, 32).astype(np.uint32)
                lang = np.repeat(langs[i:j], np.diff(o))
                for name in dict.fromkeys(langs[i:j]):
                    grams, n = np.unique(codes[lang == name], return_counts=True)
                    if name in held:
                        was, m = held[name]
                        both, inverse = np.unique(np.concatenate([was, grams]), return_inverse=True)
                        grams, n = both, np.bincount(inverse, np.concatenate([m, n]), len(both)).astype(np.int64)
                    held[name] = grams, n
        for name, (grams, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths, in bits.

    Of a byte after one: a table of 2^16 for each language, escapes worked in. After two: a row for every
    three bytes seen in any language, and what the escape from each two bytes costs.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.seen = np.unique(gram)
        #: place among the seen ones plus one, by three bytes; only the pages of codes that occur take memory
        self.slot = np.zeros(1 << 24, np.int32)
        self.slot[self.seen] = np.arange(1, len(self.seen) + 1)
        self.one = np.empty((len(langs), 1 << 16), np.float32)
        self.escape = np.zeros((len(langs), 1 << 16), np.float32)
        self.lengths = np.zeros((len(langs), len(self.seen) + 1), np.float32)
        two = self.seen >> 8
        for k in range(len(langs)):
            mine, count = gram[lang == k], n[lang == k]
            c1 = np.bincount(mine & 0xFFFF, count, 1 << 16).reshape(256, 256)
            p = self._level(c1.sum(0, keepdims=True), np.full((1, 256), 1 / 256))
            p1 = self._level(c1, p).ravel()
            self.one[k] = -np.log2(p1)
            own = np.bincount(np.searchsorted(self.seen, mine), count, len(self.seen))
            total, kinds = np.bincount(two, own, 1 << 16), np.bincount(two[own > 0], minlength=1 << 16)
            known = total > 0
            out = np.ones(1 << 16)
            out[known] = kinds[known] / (total + kinds)[known]
            self.escape[k] = -np.log2(out)
            p2 = np.where(own > 0, own / np.maximum(total + kinds, 1)[two], out[two] * p1[self.seen & 0xFFFF])
            self.lengths[k, 1:] = -np.log2(p2)

    @staticmethod
    def _level(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities with one more byte of context, escaping to lower where a symbol is new."""
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        whole = np.maximum(total + kinds, 1)
        return np.where(counts > 0, counts / whole, np.where(total > 0, kinds / whole, 1.0) * lower)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language."""
        out = np.zeros((len(self.langs), len(offsets) - 1))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            codes = contexts(data, offsets, 256, 32)
            slot = self.slot[codes]
            new = np.flatnonzero(slot == 0)
            two, one = codes[new] >> 8, codes[new] & 0xFFFF
            for k, lengths in enumerate(self.lengths):
                each = lengths[slot]
                each[new] = self.escape[k][two] + self.one[k][one]
                out[k, full] = np.add.reduceat(each, offsets[full], dtype=np.float64)
        return out


_MODELS: dict[str, Model] = {}


def _model(shared) -> Model | None:
    key, langs, lang, gram, n = shared.value
    if not langs:
        return None
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(langs, lang, gram, n)
    return _MODELS[key]


def learn(labelled: DataFrame):
    """The counts of all labelled rows, broadcast: a row for each kind of three bytes in a language, 2^24 a language at most; texts bring some 10^5."""
    import uuid

    spark = labelled.sparkSession
    ship(spark)
    rows = gram_counts(labelled).toArrow()
    names = rows.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in names], np.int64)
    return spark.sparkContext.broadcast((uuid.uuid4().hex, langs, lang, rows.column("gram").to_numpy(), rows.column("n").to_numpy().astype(np.float64)))


def predict(docs: DataFrame, shared, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with lang_pred, score, bits_per_byte and lettered, from text alone."""
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType()), T.StructField("lettered", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            data, offsets = flat(text)
            preds: list[str] = []
            scores, rates, lettered = np.zeros(len(text)), np.zeros(len(text)), np.zeros(len(text), bool)
            for i, j, d, o in slices(data, offsets):
                sizes = np.diff(o)
                letter = np.zeros(j - i, bool)
                full = np.flatnonzero(sizes > 0)
                if len(full):
                    letter[full] = np.logical_or.reduceat(_ASCII_LETTER[d], o[full])
                for r in np.flatnonzero(~letter & (sizes > 0)):
                    letter[r] = any(c.isalpha() for c in text[i + int(r)].as_py())
                lettered[i:j] = letter
                if model is None:
                    preds += ["und"] * (j - i)
                    continue
                bits = model.bits(d, o)
                best = bits.argmin(0)
                share = 1 / np.exp2(np.minimum(0, bits.min(0) - bits)).sum(0)
                preds += [model.langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                scores[i:j] = np.where(letter, share, 0)
                rates[i:j] = bits.min(0) / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores), pa.array(rates), pa.array(lettered)], [*keep, "lang_pred", "score", "bits_per_byte", "lettered"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shared = learn(docs.where((fold() != HELD_OUT) & F.col("lang").isNotNull()))
    out = predict(docs.withColumn("held_out", fold() == HELD_OUT), shared, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language nothing tells: no text, or no letter. With nothing to learn from, lettered rows stay."""
    shared = learn(docs.where((fold() != HELD_OUT) & F.col("lang").isNotNull()))
    # under names of their own: docs may have columns named as the predictions are
    own = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    out = predict(docs.select(*[F.col(c).alias(x) for c, x in own.items()], "text"), shared, list(own.values()))
    return out.where("lettered").select(*[F.col(x).alias(c) for c, x in own.items()])

"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Targets: sources share the words of all documents by weight, none above MOST times its own words; what a
capped source leaves is shared again. A target is met by whole passes over the source and a last, partial
pass in a fixed random order; what the order leaves short is topped up by the TOP_UPS documents that come nearest.
If documents that fit are left then, the pass goes on behind the place where it stopped, over those that fit, until
no document fits in what is short.

Shards: a pass of a source is cut into BLOCKS random blocks. The tree deals all blocks to 2^LEVELS shards:
at each node a uniformly random half of its blocks goes left, so the blocks of each source in it follow the
multivariate hypergeometric law and counts are exact. The counts are the shards' quotas; each source's
blocks, in a random order of their own, are then handed out as disjoint runs of those lengths, and rows
carry a key that orders them at random within their shard.

All randomness is MD5 of seed and ids, so reruns agree. DataFrame functions only. Deciding tables are of
bounded size (sources x 256 rows, or x 769 for shards); prefix sums over documents run only inside one of
65,536 random slices of a source.

Null texts have size 0 and are never taken; a null source is a source of its own, last in order; repeated
rows of one doc_id are taken together; texts are counted whole however long; ties in the order of keys are none, as equal
keys are taken together; an empty table gives an empty result; extra columns pass through, but for
those named as the columns that ``draws`` adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Workspace, table

MOST = 3
WEIGHTS = (1, 2, 3)
LEVELS = 4
TOP_UPS = 4
SEED = "mix"
SMALL_ROWS = 100_000  # a deciding table is broadcast only when counted and not larger


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Orders as the source does, null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def doc_key(doc_id: Column) -> Column:
    return _hash(F.coalesce(doc_id.cast("string"), F.lit("null")))


@dataclass
class Plan:
    """sources: per source its size, target, whole passes, and what the last pass takes; shards: per block."""

    ws: Workspace
    sources: DataFrame
    shards: DataFrame
    extra: DataFrame | None = None  # (s, key) that the last pass took when it went on


def targets(sources: DataFrame) -> DataFrame:
    """sources (s, source_size) with target: min(MOST x size, weight x level), all sharing the total."""
    every = W.partitionBy(F.lit(0)).orderBy("s")
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(every) - 1) % len(WEIGHTS) + 1).cast("int")))
    by_ratio = W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "s")
    whole = W.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    capped_before = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - capped_before).cast("double") / weight_left)
    s = s.withColumn("free", F.col("source_size") * MOST > F.col("level") * F.col("weight"))
    s = s.withColumn("common", F.max(F.when(F.col("free"), F.col("level"))).over(whole))
    return s.withColumn("target", F.when(F.col("free"), F.col("common") * F.col("weight")).otherwise((F.col("source_size") * MOST).cast("double"))).select("s", "source_size", "target")


def _cut(rows: DataFrame, state: DataFrame, digit: Column) -> DataFrame:
    """state (s, rest) with the slice of rows (s, key, size) in which the running sum passes rest, and what is left of rest there."""
    sums = rows.groupBy("s", digit.alias("slice")).agg(F.sum("size").alias("n"))
    run = sums.withColumn("c", F.sum("n").over(W.partitionBy("s").orderBy("slice")))
    at = run.join(state.select("s", "rest"), "s").where((F.col("c") > F.col("rest")) & (F.col("c") - F.col("n") <= F.col("rest")))
    return at.select("s", "slice", (F.col("rest") - F.col("c") + F.col("n")).alias("left"))


def _cut_documents(ws: Workspace, rows: DataFrame, state: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Where the running sum of rows passes rest: (s, upto, short, last_block) of the sources in which it does, upto the last key that fits."""
    first = _cut(rows, state, F.substring("key", 1, 2))
    part = rows.join(first.select("s", F.col("slice").alias("b"), F.col("left").alias("rest")), "s").where(F.substring("key", 1, 2) == F.col("b"))
    part = ws.write(part, name)
    second = _cut(part.select("s", "key", "size"), part.groupBy("s").agg(F.first("rest").alias("rest")), F.substring("key", 3, 2))
    last = part.drop("rest").join(second.select("s", F.col("slice").alias("b2"), "left"), "s").where(F.substring("key", 3, 2) == F.col("b2"))
    run = last.withColumn("c", F.sum("size").over(W.partitionBy("s").orderBy("key")))
    fits = F.col("c") <= F.col("left")
    ends = run.groupBy("s").agg(
        F.coalesce(F.max(F.when(fits, F.col("key"))), F.first(F.concat("b", "b2"))).alias("upto"),
        (F.first("left") - F.coalesce(F.max(F.when(fits, F.col("c"))), F.lit(0))).alias("short"),
        F.first("b").alias("last_block"),
    )
    return ends, part


def _go_on(ws: Workspace, rows: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """now, and (s, key) of further documents: in the order of keys behind upto, those that fit, until none does."""
    taken: list[DataFrame] = []
    left = now.select("s", "upto", "more", "short")
    while True:
        n = len(taken)
        fit = rows.join(left, "s").where((F.col("size") > 0) & (F.col("size") <= F.col("short")) & (F.col("key") > F.col("upto")) & ~F.array_contains("more", F.col("key")))
        fit = ws.write(fit.select("s", "key", "size"), f"fit-{n}")
        if fit.isEmpty():
            break
        ends, part = _cut_documents(ws, fit, left.select("s", F.col("short").alias("rest")), f"cut-{n}")
        ends = ws.write(ends, f"ends-{n}")
        mine = fit.join(ends.select("s", F.col("upto").alias("end")), "s", "left").where(F.col("end").isNull() | (F.col("key") <= F.col("end")))
        taken.append(ws.write(mine.select("s", "key", "size"), f"taken-{n}"))
        # a source whose sum never passes took all that fit
        left = ws.write(left.select("s", "more").join(ends.select("s", "upto", "short"), "s").select("s", "upto", "more", "short"), f"left-{n}")
        ws.drop(fit, part)
    if not taken:
        return now, None
    extra = taken[0]
    for more in taken[1:]:
        extra = extra.union(more)
    ends = extra.groupBy("s").agg(F.max(F.substring("key", 1, 2)).alias("block"), F.sum("size").alias("n"))
    after = now.join(ends, "s", "left").withColumn("last_block", F.greatest("last_block", "block")).withColumn("short", F.col("short") - F.coalesce("n", F.lit(0)))
    return ws.write(after.drop("block", "n"), "filled"), extra.select("s", "key")


def plan(docs: DataFrame, label: str = "mixing", levels: int = LEVELS, size: Column | None = None) -> Plan:
    ws = Workspace(docs.sparkSession, label)
    size = n_words(F.col("text")) if size is None else size
    sized = docs.select(_source_key(F.col("source")).alias("s"), doc_key(F.col("doc_id")).alias("key"), size.alias("size"))
    rows = ws.write(sized.groupBy("s", "key").agg(F.sum("size").alias("size")), "rows")
    state = targets(rows.groupBy("s").agg(F.sum("size").alias("source_size")))
    quota = F.floor("target")
    state = state.withColumn("full", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    state = ws.write(state.withColumn("rest", (quota - F.col("full") * F.col("source_size")).cast("long")), "targets")

    # the last pass: whole slices by the first and second byte of the key, then documents one by one
    ends, part = _cut_documents(ws, rows, state, "first")
    now = state.join(ends, "s", "left").select(
        "s", "source_size", "target", "full", F.coalesce("upto", F.lit("")).alias("upto"), F.coalesce("last_block", F.lit("")).alias("last_block"),
        F.array().cast("array<string>").alias("more"), F.coalesce("short", F.lit(0)).alias("short"),
    )
    now = ws.write(now, "top-0")
    for k in range(TOP_UPS):
        fit = rows.join(now.select("s", "upto", "more", "short"), "s").where((F.col("size") > 0) & (F.col("size") < 2 * F.col("short")) & (F.col("key") > F.col("upto")) & ~F.array_contains("more", F.col("key")))
        best = fit.groupBy("s").agg(F.max(F.struct((-F.abs(F.col("short") - F.col("size"))).alias("near"), "size", "key")).alias("best"))
        added = F.when(F.col("best").isNotNull(), F.concat("more", F.array("best.key"))).otherwise(F.col("more"))
        after = now.join(best, "s", "left").withColumn("more", added).withColumn("short", F.col("short") - F.coalesce("best.size", F.lit(0))).drop("best")
        now = ws.write(after, f"top-{k + 1}")
    now, extra = _go_on(ws, rows, now)
    ws.drop(rows, state, part)
    return Plan(ws, now, ws.write(_shards(now, levels), "shards"), extra)


def _shards(sources: DataFrame, levels: int) -> DataFrame:
    """(s, block, in_pass, shard): the tree's quotas, and the runs of blocks that fill them."""
    block = F.explode(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lower(F.lpad(F.hex(i), 2, "0")))).alias("block")
    passes = sources.select("s", "full", "upto", "last_block", F.explode(F.sequence(F.lit(1), F.col("full") + 1)).alias("in_pass"))
    tokens = passes.select("s", "full", "last_block", "in_pass", block)
    tokens = tokens.where((F.col("in_pass") <= F.col("full")) | (F.col("block") <= F.col("last_block"))).select("s", "in_pass", "block", F.lit(0).alias("node"))
    for level in range(levels):
        within = W.partitionBy("node")
        rank = F.row_number().over(within.orderBy(_hash(f"tree{level}", F.col("s"), F.col("in_pass").cast("string"), F.col("block"))))
        tokens = tokens.select("s", "in_pass", "block", (F.col("node") * 2 + F.when(rank * 2 <= F.count("*").over(within), 0).otherwise(1)).alias("node"))
    quotas = tokens.groupBy("s", F.col("node").alias("shard")).agg(F.count("*").alias("quota"))
    upto = F.sum("quota").over(W.partitionBy("s").orderBy("shard"))
    quotas = quotas.select("s", "shard", upto.alias("upto"), (upto - F.col("quota")).alias("after"))
    place = F.row_number().over(W.partitionBy("s").orderBy(_hash("draw", F.col("s"), F.col("in_pass").cast("string"), F.col("block"))))
    drawn = tokens.select("s", "in_pass", "block", place.alias("place"))
    return drawn.join(quotas, "s").where((F.col("place") > F.col("after")) & (F.col("place") <= F.col("upto"))).groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("in_pass", "shard"))).alias("dealt"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def draws(docs: DataFrame, made: Plan | None = None, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and draws: array<struct<in_pass, shard>>, one for each time the row is taken.

    size is the rows' own where they are counted already; else the words of text are counted. Columns of docs by these four
    names are replaced; all others pass, whatever their names.
    """
    made = made or plan(docs, size=size)
    size = n_words(F.col("text")) if size is None else size
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "draws")]
    rows = docs.select(F.struct(*kept).alias("row"), _source_key(F.col("source")).alias("s"), doc_key(F.col("doc_id")).alias("key"), size.alias("size"))
    rows = rows.withColumn("block", F.substring("key", 1, 2))
    rows = rows.join(_small(made.sources.select("s", "source_size", "target", "full", "upto", "more")), "s")
    rows = rows.join(_small(made.shards.select("s", "block", "dealt")), ["s", "block"], "left")
    topped = F.array_contains("more", F.col("key"))
    if made.extra is not None:
        rows = rows.join(_small(made.extra.select("s", "key", F.lit(True).alias("extra"))), ["s", "key"], "left")
        topped = topped | F.coalesce("extra", F.lit(False))
    last = (F.col("size") > 0) & ((F.col("key") <= F.col("upto")) | topped)
    whole = F.filter(F.coalesce("dealt", F.array().cast(made.shards.schema["dealt"].dataType)), lambda x: x["in_pass"] <= F.col("full"))
    shard = F.try_element_at(F.transform(F.filter("dealt", lambda x: x["in_pass"] > F.col("full")), lambda x: x["shard"]), F.lit(1))
    one = F.array(F.struct((F.col("full") + 1).alias("in_pass"), F.coalesce(shard, F.lit(0)).alias("shard")))
    taken = F.when(F.col("size") <= 0, F.array().cast(made.shards.schema["dealt"].dataType)).when(last, F.concat(whole, one)).otherwise(whole)
    # a step of its own: inside a function of arrays a name would be taken for one of row's
    rows = rows.select("row", "size", "source_size", "target", taken.alias("draws"))
    return rows.select("row.*", "size", "source_size", "target", "draws")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: a row for each draw, with shard and the key that orders rows at random within it."""
    d = draws(docs).withColumn("draw", F.explode("draws"))
    key = _hash("order", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("draw.in_pass").cast("string"))
    return d.select(*docs.columns, F.col("draw.in_pass").alias("in_pass"), F.col("draw.shard").alias("shard"), key.alias("order_key"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix with the columns of docs, whatever their names: shard after shard, shuffled within each."""
    rows = mixed(docs.select("doc_id", "source", "text", F.struct("*").alias("_row")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("shard", "order_key", "_row").repartitionByRange(parts, "shard", "order_key").sortWithinPartitions("shard", "order_key")
    return dealt.select("_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    docs = Workspace(spark, "sizes").write(docs, "sizes")  # the result has no texts, so they are read once
    shards = F.array_join(F.transform("draws", lambda x: x["shard"].cast("string")), ",")
    return draws(docs, size=F.col("size")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), shards.alias("shards"))

"""Retries as data: schedules of delays, and the attempt that ends a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRYABLE = (429, 502, 503, 504)


def backoff(delay: Column | float, attempt: Column) -> Column:
    """Seconds to wait after an attempt, doubling each time."""
    d = delay if isinstance(delay, Column) else F.lit(float(delay))
    return d * F.pow(F.lit(2.0), attempt)


def schedule(delay: float, retries: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(retries - 1)), lambda i: backoff(delay, i))


def wait(delay: Column | float, attempt: Column, retry_after: Column) -> Column:
    """A server's number of seconds, where it gives one, overrides the backoff."""
    return F.when(F.coalesce(retry_after, F.lit("")).rlike("^[0-9]+$"), retry_after.try_cast("double")).otherwise(backoff(delay, attempt))


def finished(attempts: DataFrame, most: int, delay: float) -> DataFrame:
    """The end of each request of attempts (request_id, attempt, code): its last attempt, code, success, and seconds waited.

    A request ends at its first attempt that isn't retryable, or at attempt most.
    """
    ends = ~F.col("code").isin(*RETRYABLE) | (F.col("attempt") >= most)
    rows = attempts.where(F.col("attempt") <= most).groupBy("request_id").agg(F.min_by(F.struct("attempt", "code"), F.when(ends, F.col("attempt"))).alias("e"))
    waited = F.lit(float(delay)) * (F.pow(F.lit(2.0), F.col("e.attempt")) - 1)
    return rows.select("request_id", F.col("e.attempt").alias("attempts_before"), F.col("e.code").alias("code"), (F.col("e.code") < 400).alias("ok"), waited.alias("waited"))


def tool_outcome(attempts: DataFrame, retries: int, delay: float) -> DataFrame:
    """The end of each tool call of attempts (call_id, attempt, exit_code, output): its first success, or its last attempt of retries + 1.

    Between attempts a fixed delay passes. output is the tool's text, of a success; error tells of the last failure.
    """
    ends = (F.col("exit_code") == 0) | (F.col("attempt") >= retries)
    end = F.min_by(F.struct("attempt", "exit_code", "output"), F.when(ends, F.col("attempt"))).alias("e")
    rows = attempts.where(F.col("attempt") <= retries).groupBy("call_id").agg(end, F.max_by(F.struct("attempt", "exit_code", "output"), "attempt").alias("l"))
    rows = rows.withColumn("e", F.coalesce("e", "l"))
    ok = F.col("e.exit_code") == 0
    failed = F.concat(F.lit("MCP command failed with exit code "), F.col("e.exit_code").cast("string"), F.lit(": "), F.trim("e.output"))
    return rows.select("call_id", F.col("e.attempt").alias("retried"), ok.alias("ok"), F.when(ok, F.trim("e.output")).alias("stdout"), F.when(~ok, failed).alias("error"), (F.col("e.attempt") * F.lit(float(delay))).alias("waited"))

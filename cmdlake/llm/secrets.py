"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger is a table that stays: a scan reads only
those (blob, rule version) pairs that it does not hold, once per distinct blob however many paths and versions carry it,
appends them, and findings are joined back to all paths and versions. All steps are DataFrame functions.

Rows of versions need a text; a path, a version and all else pass through. Null texts count as empty; empty texts have no
findings; texts are scanned whole however long; equal texts share one blob, repeated rows are versions of their own; of matches that start
at one place the kind listed first stands first; columns named blob and findings are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    cheap: str = ""  # necessary for any match, quicker to test


#: Fixed patterns of the contract, in its order. A run of hex digits or capitals is matched whole, so the
#: least length can stand in the pattern; for "assign" it is tested after matching, as matches consume text.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", cheap="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Spans the method adds after the base ones.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", cheap="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", cheap="eyJ"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_no, kind, end>> of a rule's matches: code points, end exclusive.

    Matches and the pieces between them alternate, so running sums of their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    none = F.lit(None).cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        one = F.struct(start.alias("start"), F.lit(order).alias("kind_no"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        keep = F.length(x["held"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>").alias("out"))
    pieces = F.zip_with(F.arrays_zip(found.alias("found"), held.alias("held")), between, lambda m, b: F.struct(m["found"].alias("found"), m["held"].alias("held"), b.alias("between")))
    walked = F.aggregate(F.filter(pieces, lambda x: x["found"].isNotNull()), start, step)["out"]
    hit = text.contains(rule.cheap) if rule.cheap else text.rlike(rule.pattern)
    return F.coalesce(F.when(hit, walked), none)


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule_version, findings) for versions (text) that the ledger lacks.

    Copies are combined before the shuffle, so a blob with very many paths is not gathered anywhere.
    """
    text = F.coalesce("text", F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    parts = [F.coalesce(spans_of(F.col("body"), r, i), F.array()) for i, r in enumerate(rules)]
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), F.array_sort(F.concat(*parts)).alias("findings"))


LEDGER = "blob string, rule_version string, findings array<struct<start:int,kind_no:int,kind:string,end:int>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger below path, empty where there is none; a pair that two runs appended at once counts once."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Appends what the ledger below path lacks of versions, and gives it back, one row for each blob of this rule version.

    Without a path the ledger lives as long as the program. Read from its table it joins without an aggregate
    between, so a blob on very many paths can be split.
    """
    spark = versions.sparkSession
    path = path or f"{Workspace(spark, 'ledger').root}/ledger"
    known = read_ledger(spark, path)
    scan(versions, rules, rule_version, known).write.mode("append").option("compression", "zstd").parquet(path)
    ledger = read_ledger(spark, path).where(F.col("rule_version") == rule_version)
    if ledger.groupBy("blob").count().where("count > 1").isEmpty():
        return ledger
    return Workspace(spark, "ledger").write(ledger.dropDuplicates(["blob"]), "single")


def findings_by_path(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Every row of versions with its blob and findings, which replace columns of those names; an empty array where there are none."""
    rows = versions.drop("blob", "findings").withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings")
    return rows.join(known, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(ledger.schema["findings"].dataType)))


def redact(text: Column, findings: Column) -> Column:
    """text with each finding replaced by [kind]; a finding that starts inside an earlier one joins it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(findings, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def joined(findings: Column) -> Column:
    return F.concat_ws(",", F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    by_path = findings_by_path(docs, update_ledger(docs)).select("doc_id", "findings")
    base = F.filter("findings", lambda x: x["kind_no"] < len(BASE_RULES))
    counts = [F.size(F.filter("findings", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return by_path.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def oracle_op8() -> str:
    """DuckDB SQL: the same spans from matches and the pieces between them."""
    def one(rule: Rule, order: int) -> str:
        p = rule.pattern.replace("'", "''").replace(r"\x20", " ")
        return f"""select doc_id, rn, {order} as kind_no, '{rule.kind}' as kind, f, h, b, k from (
          select doc_id, rn, unnest(regexp_extract_all(t, '{p}', 0)) as f, unnest(regexp_extract_all(t, '{p}', {rule.group})) as h,
            unnest(string_split_regex(t, '{p}')[:-2]) as b, unnest(range(1, 1 + len(regexp_extract_all(t, '{p}', 0)))) as k
          from docs where regexp_matches(t, '{p}'))"""

    parts = " union all ".join(one(r, i) for i, r in enumerate(RULES))
    least = " ".join(f"when '{r.kind}' then {r.least}" for r in RULES)
    return f"""
    with docs as (select doc_id, row_number() over () as rn, coalesce(text, '') as t from documents),
    m as ({parts}),
    p as (select *, sum(length(b) + length(f)) over (partition by rn, kind_no order by k) as e from m),
    s as (select rn, kind_no, kind, e - length(f) as s, e from p where length(h) >= case kind {least} end),
    g as (select rn, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
        count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) filter (kind_no < {len(BASE_RULES)}) as base,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) as spans from s group by rn)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join g using (rn)"""

"""Row-wise functions on payloads: keys, required fields, templates, references, text that may be JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


def last_wins(keys: Column, values: Column) -> Column:
    """A map of two arrays; a key that comes again keeps its first place and gets the last value."""
    distinct = F.array_distinct(keys)
    # from the end, the first place of a key is its last one
    back, last = F.reverse(keys), F.reverse(values)
    slow = F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.element_at(last, F.array_position(back, k).cast("int"))))
    return F.when(F.size(distinct) == F.size(keys), F.map_from_arrays(distinct, values)).otherwise(slow)


def rekey(data: Column, f: Callable[[Column], Column]) -> Column:
    """data with every top-level key replaced; of keys that fall together the later wins."""
    return last_wins(F.transform(F.map_keys(data), f), F.map_values(data))


def uppercase_keys(data: Column) -> Column:
    return rekey(data, F.upper)


def lowercase_keys(data: Column) -> Column:
    return rekey(data, F.lower)


def overlay(*layers: Column) -> Column:
    """Maps laid over each other, the right one on top; values are replaced whole. A null layer adds nothing."""
    empty = F.create_map().cast("map<string,string>")
    full = [F.coalesce(x, empty) for x in layers]
    return last_wins(F.concat(*map(F.map_keys, full)), F.concat(*map(F.map_values, full)))


def redact(data: Column, keys: Iterable[str] = ("api_key",)) -> Column:
    """data with the values of secret keys covered."""
    return F.transform_values(data, lambda k, v: F.when(k.isin(*keys), F.lit("REDACTED")).otherwise(v))


def missing_fields(data: Column, required: Column) -> Column:
    """A message for each required field that is absent or null, in order, repeats included."""
    lacking = F.filter(required, lambda f: ~F.coalesce(F.map_contains_key(data, f), F.lit(False)) | data[f].isNull())
    return F.transform(lacking, lambda f: F.concat(F.lit("Missing required field: "), f))


def fill_template(template: Column, variables: Column, values: Column) -> Column:
    """template with ``{name}`` replaced for each declared variable that has a value, one after the other."""
    return F.aggregate(
        variables, template, lambda t, v: F.when(F.map_contains_key(values, v), F.replace(t, F.concat(F.lit("{"), v, F.lit("}")), F.coalesce(values[v], F.lit("None")))).otherwise(t)
    )


def resolve_env(text: Column, env: Column) -> Column:
    """text with each ``${NAME}`` replaced by env's value, or by nothing where env has none."""
    names = F.regexp_extract_all(text, F.lit(r"\$\{([A-Za-z0-9_]+)\}"), F.lit(1))
    return F.aggregate(names, text, lambda t, n: F.replace(t, F.concat(F.lit("${"), n, F.lit("}")), F.coalesce(F.try_element_at(env, n), F.lit(""))))


def json_or_stdout(text: Column) -> Column:
    """JSON text as it is; other text trimmed and wrapped as ``{"stdout": ...}``."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.to_json(F.struct(F.trim(text).alias("stdout"))))


def compact(**fields: Column) -> Column:
    """A JSON object of the fields that are not null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def parse_bool(text: Column, accepted: Iterable[str] = ("true", "yes", "1", "on")) -> Column:
    return F.lower(text).isin(*accepted)


def parse_int(text: Column) -> Column:
    """struct<value, valid>: a whole number with an optional sign; white space around it is allowed."""
    value = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("int"))
    return F.struct(value.alias("value"), value.isNotNull().alias("valid"))


def as_enum(text: Column, domain: Iterable[str], field: str = "status") -> Column:
    """struct<value, error>: text where it is in the domain, else the reason."""
    ok = F.coalesce(text.isin(*domain), F.lit(False))
    return F.struct(F.when(ok, text).alias("value"), F.when(~ok, F.concat(F.lit(f"Invalid {field} value: "), F.coalesce(text, F.lit("None")))).alias("error"))


def normalise_url(url: Column) -> Column:
    """url with http:// where it names no scheme, without slashes at its end."""
    return F.regexp_replace(F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("http://"), url)), "/+$", "")


def env_layer(env: Column, prefix: str, skip: str | None = None) -> Column:
    """The entries of env under prefix, keys without it and in lower case; those that start with skip are left out."""
    own = F.map_filter(env, lambda k, _: k.startswith(prefix))
    out = rekey(own, lambda k: F.lower(F.substring(k, len(prefix) + 1, F.length(k))))
    return F.map_filter(out, lambda k, _: ~k.startswith(skip)) if skip else out


def flatten_struct(schema: T.StructType, at: str = "", path: str = "") -> list[tuple[str, Column]]:
    """(dotted path, column) of every leaf of a struct, depth first; lists are leaves, empty structs vanish."""
    out: list[tuple[str, Column]] = []
    for f in schema.fields:
        here, name = (f"{at}.`{f.name}`" if at else f"`{f.name}`"), (f"{path}.{f.name}" if path else f.name)
        out += flatten_struct(f.dataType, here, name) if isinstance(f.dataType, T.StructType) else [(name, F.col(here))]
    return out


def flatten_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) for each leaf of a struct column; a path that comes again keeps its last value."""
    leaves = dict(flatten_struct(df.schema[column].dataType, f"`{column}`"))
    entries = F.array(*[F.struct(F.lit(p).alias("path"), c.cast("string").alias("value")) for p, c in leaves.items()])
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.path", "e.value")


def flat_items(record: dict) -> dict:
    """Dotted paths to what isn't an object, depth first; a path that comes again keeps its first place and gets the last value."""
    out: dict = {}
    stack = [("", iter(record.items()))]
    while stack:
        path, items = stack[-1]
        for k, v in items:
            here = f"{path}.{k}" if path else k
            if isinstance(v, dict):
                stack.append((here, iter(v.items())))
                break
            out[here] = v
        else:
            stack.pop()
    return out


def _flattened(as_text: bool):
    """An Arrow function from JSON objects to flat ones; objects nest to any depth, which no fixed plan covers."""
    ship(SparkSession.active())

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            record = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if not isinstance(record, dict):
            return None
        flat = flat_items(record)
        if as_text:
            flat = {k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in flat.items()}
        return json.dumps(flat, ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def flatten(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return flatten


def flatten_text(text: Column) -> Column:
    """JSON text of an object, flattened; null for other text."""
    return _flattened(False)(text)


def flatten_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) for each leaf of JSON text of any shape; value is JSON text. Lists are leaves, empty objects vanish.

    One pass without a shuffle, whatever the number of rows; text that is no object gives no rows.
    """
    leaves = F.from_json(_flattened(True)(F.col(column)), "map<string,string>")
    return df.select(F.col(key), leaves.alias("_leaves")).select(key, F.explode("_leaves").alias("path", "value"))

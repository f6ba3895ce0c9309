"""Canonical JSON and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(columns: dict[str, Column]) -> Column:
    """Columns as JSON with sorted names; nulls and NaNs are written as null."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def state_hash(json: Column, active: Column) -> Column:
    return F.sha1(F.concat(json, F.lit("|"), active.cast("int").cast("string")))


def visitor_hash(address: Column, agent: Column, day: Column, salt: str) -> Column:
    return F.substr(F.sha2(F.concat_ws("|", address, agent, day, F.lit(salt)), 256), F.lit(1), F.lit(16))


def json_lines(c: Column) -> Column:
    """The non-empty items of a JSON list of texts."""
    return F.filter(F.from_json(c, "array<string>"), lambda x: F.trim(x) != "")

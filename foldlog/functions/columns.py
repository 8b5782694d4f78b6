"""Scalar functions of event data: keys, saturating arithmetic, days, retry delays, names."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def saturating_sub(a: Column | str, b: Column | str) -> Column:
    """a - b, at least 0; a missing side counts as 0."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0)) for x in (a, b))
    return F.greatest(a - b, F.lit(0))


def epoch_day(millis: Column) -> Column:
    return F.floor(millis / F.lit(DAY_MS)).cast("long")


def storage_key(prefix: str, *parts: Column | str) -> Column:
    """prefix and the parts' text, as in order:17 or sku::4: one way only, so parts must not hold the separator."""
    return F.concat(F.lit(prefix), F.concat_ws("::", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def split_key(key: Column, separator: str = "::") -> Column:
    """The two parts of a key as a struct; null if there aren't exactly two."""
    parts = F.split(key, re.escape(separator), -1)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("left"), parts[1].alias("right")))


def retry_delay(index: Column, initial_ms: int, max_ms: int) -> Column:
    """min(initial * 2 ** index, max), saturating."""
    return F.least(F.lit(float(initial_ms)) * F.pow(F.lit(2.0), F.least(index, F.lit(62))), F.lit(float(max_ms))).cast("long")


def after(columns: list[Column | str], values: list) -> Column:
    """Whether a tuple of columns comes after a tuple of values, the first that differs deciding."""
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    names = [f"c{i}" for i in range(len(columns))]
    own = F.struct(*[c.alias(n) for c, n in zip(columns, names, strict=True)])
    return own > F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(values, names, strict=True)])


def causation(kind: Column, aggregate_id: Column) -> Column:
    return F.concat(kind, F.lit("@"), aggregate_id)


def json_key(value: object) -> str:
    """Deterministic, injective text of an id: 7 and "7" differ, None is null."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def kebab_case(name: str) -> str:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1-\2", name))
    return spaced.replace("_", "-").lower()


def upper_camel(path: str) -> str:
    """A dotted or :: path as one name: shop.Placed gives ShopPlaced."""
    return "".join(p[:1].upper() + p[1:] for part in re.split(r"::|\.", path) for p in part.split("_") if p)

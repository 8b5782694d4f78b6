"""Payload schemas by kind, versions, and decoding with explicit errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Schema:
    """A payload: its fields, and those that may be missing or null with the defaults that take their place."""

    fields: T.StructType
    defaults: tuple[tuple[str, object], ...] = ()

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.name not in dict(self.defaults)]

    def _raw(self, data: Column) -> Column:
        return F.from_json(data, self.fields, {"mode": "PERMISSIVE"})

    def payload(self, data: Column, strict: bool = False) -> Column:
        """The decoded payload; where outcome() isn't ok, null, or with strict an error that ends the query."""
        raw, defaults = self._raw(data), dict(self.defaults)
        fields = [F.coalesce(raw[f.name], F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) if f.name in defaults else raw[f.name].alias(f.name) for f in self.fields]
        outcome = self.outcome(data)
        other = F.raise_error(F.concat(F.lit("a payload can't be decoded ("), outcome, F.lit("): "), F.coalesce(data, F.lit("null")))) if strict else F.lit(None)
        return F.when(outcome == "ok", F.struct(*fields)).otherwise(other)

    def outcome(self, data: Column) -> Column:
        """ok, missing_field (a required field isn't there), or bad_data (not a JSON object, a required field that is null, or any field of another type)."""
        there = F.json_object_keys(data)
        raw = self._raw(data)
        missing = F.size(F.array_except(F.array(*map(F.lit, self.required)), F.coalesce(there, F.array().cast("array<string>")))) > 0
        unread = F.lit(False)
        for f in self.fields:
            unread |= raw[f.name].isNull() & (F.lit(f.name in self.required) | F.get_json_object(data, f"$.{f.name}").isNotNull())
        return F.when(there.isNull(), F.lit("bad_data")).when(missing, F.lit("missing_field")).when(unread, F.lit("bad_data")).otherwise(F.lit("ok"))

    def decode(self, rows: DataFrame, strict: bool = False) -> DataFrame:
        return rows.withColumn("payload", self.payload(F.col("data"), strict))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: The last version of a sent parcel: the first had no sender, the second no route.
PARCEL_SENT = Schema(_struct(revision=T.LongType(), item=T.StringType(), pieces=T.LongType(), sender=T.StringType(), route=T.StringType()), (("revision", 1), ("sender", "anonymous"), ("route", "standard")))
_USER = Schema(_struct(amount_cents=T.LongType(), k=T.LongType()))
USER_EVENTS = dict.fromkeys(("signup", "view", "purchase", "click", "error"), _USER)


def check(rows: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """rows (kind, data) with outcome: as Schema.outcome(), or unknown_kind."""
    by: dict[Schema, list[str]] = {}
    for kind, schema in schemas.items():
        by.setdefault(schema, []).append(kind)
    out = F.lit("unknown_kind")
    for schema, kinds in by.items():
        out = F.when(F.col("kind").isin(kinds), schema.outcome(F.col("data"))).otherwise(out)
    return rows.withColumn("outcome", out)

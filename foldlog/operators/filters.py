"""Event filters as column predicates.

A filter names a kind and may narrow it to a stream kind, a stream and the positions after one (exclusive). Several
filters select the union of what each selects, every event once: one predicate, which reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InvalidPosition(ValueError):
    """A position below 0."""


@dataclass(frozen=True)
class EventFilter:
    kind: str
    aggregate_kind: str | None = None
    aggregate_id: str | None = None
    after: int | None = None

    @staticmethod
    def for_event(kind: str) -> EventFilter:
        return EventFilter(kind)

    @staticmethod
    def for_aggregate(kind: str, aggregate_kind: str, aggregate_id: str) -> EventFilter:
        return EventFilter(kind, aggregate_kind, aggregate_id)

    def after_position(self, position: int) -> EventFilter:
        if position < 0:
            raise InvalidPosition(position)
        return replace(self, after=position)

    def predicate(self) -> Column:
        out = F.col("kind") == self.kind
        if self.aggregate_kind is not None:
            out &= F.col("aggregate_kind") == self.aggregate_kind
        if self.aggregate_id is not None:
            out &= F.col("aggregate_id") == self.aggregate_id
        if self.after is not None:
            out &= F.col("position") > self.after
        return out

    def matches(self, event: dict) -> bool:
        """The same for one event."""
        return (
            event["kind"] == self.kind
            and self.aggregate_kind in (None, event["aggregate_kind"])
            and self.aggregate_id in (None, event["aggregate_id"])
            and (self.after is None or event["position"] > self.after)
        )


def union_predicate(filters: Iterable[EventFilter]) -> Column:
    """What any of the filters selects; nothing if there are none.

    What holds for all of them stands before the disjunction too: it reaches the scan even if a part of the
    disjunction (an id that is computed from another column, say) can't.
    """
    filters = list(filters)
    if not filters:
        return F.lit(False)
    out = reduce(lambda a, b: a | b, [f.predicate() for f in filters])
    if len(filters) > 1:
        out = F.col("kind").isin(sorted({f.kind for f in filters})) & out
        if all(f.after is not None for f in filters):
            out = (F.col("position") > min(f.after for f in filters)) & out
    return out


def field_of(column: str, path: str, kind: str = "string") -> Column:
    """A field of data or metadata, for predicates beside filters: field_of("metadata", "user.id")."""
    return F.get_json_object(column, f"$.{path}").cast(kind)


def scan(log: DataFrame, filters: Iterable[EventFilter]) -> DataFrame:
    return log.where(union_predicate(filters))


@dataclass(frozen=True)
class Filters:
    """Filters with the handlers of the kinds that they admit. Per kind the last handler registered stands."""

    specs: tuple[EventFilter, ...] = ()
    handlers: dict = field(default_factory=dict)

    def _with(self, kinds: Iterable[str], handler, aggregate_kind: str | None = None, aggregate_id: str | None = None) -> Filters:
        kinds = list(kinds)
        return Filters(self.specs + tuple(EventFilter(k, aggregate_kind, aggregate_id) for k in kinds), self.handlers | dict.fromkeys(kinds, handler))

    def event(self, kind: str, handler=None) -> Filters:
        return self._with([kind], handler)

    def events(self, kinds: Iterable[str], handler=None) -> Filters:
        return self._with(kinds, handler)

    def event_for(self, aggregate_kind: str, kind: str, aggregate_id: str, handler=None) -> Filters:
        return self._with([kind], handler, aggregate_kind, aggregate_id)

    def events_for(self, aggregate_kind: str, kinds: Iterable[str], aggregate_id: str, handler=None) -> Filters:
        return self._with(kinds, handler, aggregate_kind, aggregate_id)

    def into_event_filters(self, after: int | None = None) -> list[EventFilter]:
        return [f if after is None else f.after_position(after) for f in self.specs]

    def predicate(self, after: int | None = None) -> Column:
        return union_predicate(self.into_event_filters(after))

"""Given some events, when a command comes, then these events follow; and helpers that put events into a log past its commands."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from foldlog.operators.repository import AggregateType, Repository, as_event
from foldlog.sources.commitlog import Event


class Scenario:
    def __init__(self, kind: AggregateType):
        self.kind, self.state, self.begun = kind, None, False
        self.result: list[Event] | None = None
        self.error: Exception | None = None

    def given(self, *events: Event) -> Scenario:
        for e in map(as_event, events):
            self.state = self.kind.step(self.state, e.kind, e.data) if self.begun else self.kind.first(e.kind, e.data)
            self.begun = True
        return self

    def when(self, name: str, command: Any) -> Scenario:
        try:
            self.result = [as_event(e) for e in (self.kind.handle[name](self.state, command) if self.begun else self.kind.handle_create[name](command))]
        except Exception as e:
            self.error = e
        return self

    def then(self, *events: Event) -> Scenario:
        if self.error is not None:
            raise AssertionError(f"the command failed: {self.error!r}") from self.error
        expected = [as_event(e) for e in events]
        assert self.result == expected, f"{self.result} instead of {expected}"
        return self

    def then_nothing(self) -> Scenario:
        return self.then()

    def then_error(self, kind: type[Exception] = Exception, containing: str = "") -> Scenario:
        assert isinstance(self.error, kind), f"{self.error!r} isn't a {kind.__name__}"
        assert containing in str(self.error), str(self.error)
        return self

    def inspect(self, check: Callable[[Iterable[Event]], bool]) -> Scenario:
        assert check(self.result or [])
        return self


def seed(repo: Repository, kind: AggregateType, aggregate_id: str, *events: Any, metadata: dict | None = None) -> int | None:
    """Events of a stream without any command or check of versions; their last position, None if there are none."""
    return repo.log.append(kind.kind, aggregate_id, [as_event(e) for e in events], metadata) if events else None


def inject_concurrent(repo: Repository, kind: AggregateType, aggregate_id: str, event: Any) -> int:
    """An event as if another writer had come first, for tests of conflicts."""
    return seed(repo, kind, aggregate_id, event)


def inject(repo: Repository, aggregate_kind: str, aggregate_id: str, event: Any, metadata: dict | None = None) -> int:
    """Any event into any stream, also of a kind that nobody knows or with data of another form."""
    return repo.log.append(aggregate_kind, aggregate_id, [as_event(event)], metadata)

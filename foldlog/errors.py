"""Errors of the log, repositories and live runners, in groups that callers can tell apart."""

from __future__ import annotations


class FoldlogError(Exception):
    pass


# --- commits


class CommitError(FoldlogError):
    """Events weren't committed."""


class SerializationError(CommitError):
    """An event of a batch can't be written; index is its place in the batch."""

    def __init__(self, index: int, reason: object):
        super().__init__(f"event {index} can't be serialised: {reason}")
        self.index = index


class ConcurrencyConflict(CommitError):
    """A stream isn't at the version that a commit expected; None stands for no stream."""

    def __init__(self, expected: int | None, actual: int | None):
        hint = "the stream already exists" if expected is None else "there is no such stream" if actual is None else "load it again and retry"
        super().__init__(f"expected version {expected}, found {actual}: {hint}")
        self.expected, self.actual = expected, actual


class StoreError(FoldlogError):
    """Files of the log can't be read or written."""


# --- commands


class LifecycleError(FoldlogError):
    """A command meets a stream that is there, or isn't, against its purpose."""


class AggregateNotFound(LifecycleError):
    pass


class AggregateAlreadyExists(LifecycleError):
    pass


class Rejected(FoldlogError):
    """Raised by a command handler: the aggregate's rules don't allow it."""


class SnapshotError(FoldlogError):
    """A snapshot failed after events were committed: they are durable, so the command must not be repeated blindly."""


# --- reading events


class EventDecodeError(FoldlogError):
    pass


class UnknownKind(EventDecodeError):
    pass


class DecodeError(EventDecodeError):
    pass


# --- live runners


class RunnerError(FoldlogError):
    pass


class SubscriptionStopped(RunnerError):
    """The runner ended before what was waited for, or with an error (its cause)."""


class CheckpointError(RunnerError):
    """A reactor's checkpoint can't be read: going on without it would repeat side effects."""


class ReactionError(FoldlogError):
    pass


class Retry(ReactionError):
    """Raised by a reaction that may succeed later."""


class Fatal(ReactionError):
    """Raised by a reaction that can't succeed."""

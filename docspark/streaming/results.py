"""Results in batches that the reader pulls, with cancellation and deadlines for running jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import Aborted, InvalidOption, TimedOut
from ..types import ID

LEAST_BATCH, MOST_BATCH, USUAL_BATCH = 1, 10_000, 100


class Signal:
    """Set from any thread to abort the operations it was given to."""

    def __init__(self) -> None:
        self._event, self._calls = threading.Event(), []

    @property
    def aborted(self) -> bool:
        return self._event.is_set()

    def abort(self) -> None:
        self._event.set()
        for f in list(self._calls):
            f()

    def on_abort(self, f: Callable[[], None]) -> Callable[[], None]:
        self._calls.append(f)
        return lambda: self._calls.remove(f) if f in self._calls else None


@contextmanager
def scope(spark: SparkSession, signal: Signal | None = None, timeout_ms: float | None = None) -> Iterator[None]:
    """Jobs started inside stop when ``signal`` aborts or the time is up; the session stays usable."""
    if timeout_ms is not None and (isinstance(timeout_ms, bool) or not isinstance(timeout_ms, (int, float)) or timeout_ms <= 0):
        raise InvalidOption("a timeout is a positive number of milliseconds")
    if signal is not None and signal.aborted:
        raise Aborted("aborted before it began")
    if signal is None and timeout_ms is None:
        yield
        return
    tag, why, sc = f"docspark-{uuid.uuid4().hex}", [], spark.sparkContext

    def stop(error: Exception) -> None:
        why.append(error)
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_ms / 1000, stop, [TimedOut(f"took more than {timeout_ms} ms")]) if timeout_ms else None
    off = signal.on_abort(lambda: stop(Aborted("aborted"))) if signal else None
    sc.addJobTag(tag)
    if timer:
        timer.daemon = True
        timer.start()
    try:
        yield
        if why:
            raise why[0]
    except Exception as e:
        if why and e is not why[0]:
            raise why[0] from e
        raise
    finally:
        sc.removeJobTag(tag)
        if timer:
            timer.cancel()
        if off:
            off()


def batches(df: DataFrame, decode: Callable[[Any], Any], size: int = USUAL_BATCH, signal: Signal | None = None, timeout_ms: float | None = None) -> Iterator[list]:
    """One job over one immutable version; a partition is fetched when the reader comes to it."""
    if isinstance(size, bool) or not isinstance(size, int) or not LEAST_BATCH <= size <= MOST_BATCH:
        raise InvalidOption(f"a batch has {LEAST_BATCH} to {MOST_BATCH} rows")
    with scope(df.sparkSession, signal, timeout_ms):
        out = []
        for row in df.toLocalIterator(prefetchPartitions=False):
            if signal is not None and signal.aborted:
                raise Aborted("aborted")
            out.append(decode(row))
            if len(out) == size:
                yield out
                out = []
        if out:
            yield out


class Matched(Collection):
    """What a mutation of more than ``MOST_BATCH`` documents returns in place of a list: the ids it matched, ascending,
    read from where it noted them, a partition at a time, whenever they are gone through. Like any reader's version they
    last until a vacuum after the lease, or until a ``:memory:`` engine closes."""

    def __init__(self, df: DataFrame, count: int, lease: Callable[[], None]) -> None:
        self._df, self._count, self._lease = df, count, lease

    def __len__(self) -> int:
        return self._count

    def __iter__(self) -> Iterator[dict]:
        self._lease()
        for row in self._df.orderBy(ID).toLocalIterator(prefetchPartitions=False):
            yield {"object_id": row[0]}

    def __contains__(self, x: Any) -> bool:
        return any(x == y for y in self)

    def __getitem__(self, i: int | slice) -> Any:
        at = range(self._count)[i]
        if isinstance(at, int):
            return next(islice(self, at, None))
        out = list(islice(self, min(at), max(at) + 1, abs(at.step))) if at else []
        return out if at.step > 0 else out[::-1]

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, (list, Matched)):
            return NotImplemented
        return len(self) == len(other) and all(x == y for x, y in zip(self, other, strict=True))

    __hash__ = None

    def __repr__(self) -> str:
        return f"<{self._count} matched ids>"

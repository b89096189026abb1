"""Attempts at answers as a stream with a state for each id: repeated deliveries, retries, and ids nobody tries any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "id string, outcome string, attempts int, answer string"
#: A bucket's ids, an element each: attempts so far, the last one, when waiting (or keeping) ends, whether the record has been written.
_STATE = "ids array<string>, tries array<int>, last_ms array<bigint>, last_seq array<bigint>, until_ms array<bigint>, done array<boolean>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Attempts(StatefulProcessor):
    """State of a bucket's ids: how many attempts, the last one, whether the record has been written. The bucket's timer is that of
    the id which ends first; it ends all that wait too long."""

    def __init__(self, tries: int, patience_ms: int, keep_ms: int):
        self.tries, self.patience, self.keep = tries, patience_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", _STATE)

    def _load(self) -> dict[str, tuple]:
        if not self.state.exists():
            return {}
        ids, *columns = self.state.get()
        return dict(zip(ids, zip(*columns)))

    def _store(self, found: dict[str, tuple]) -> None:
        if found:
            self.state.update((list(found), *map(list, zip(*found.values()))))
        else:
            self.state.clear()

    def _wait(self, before: int | None, found: dict[str, tuple]) -> None:
        """The timer of the id that ends first, in place of the one at ``before``."""
        until = _first(found)
        if until == before:
            return
        # the watermark is a millisecond behind the latest attempt, and so is the timer
        if before is not None:
            self.handle.deleteTimer(before - 1)
        if until is not None:
            self.handle.registerTimer(until - 1)

    def _new(self, rows: Iterator[pd.DataFrame], found: dict[str, tuple]) -> dict[str, dict]:
        """By id, the earliest attempts that aren't repeated deliveries: no more than can count, however many come."""
        new: dict[str, dict] = {}
        for part in rows:
            for key, *attempt, ok, answer in zip(*(part[c].tolist() for c in ("id", "at_ms", "seq", "ok", "answer"))):
                if (old := found.get(key)) and (old[4] or attempt <= [old[1], old[2]]):
                    continue
                of = new.setdefault(key, {})
                of.setdefault(tuple(attempt), (ok, answer))
                if len(of) > 2 * self.tries:
                    new[key] = {k: of[k] for k in sorted(of)[: self.tries]}
        return new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self._load()
        before, new, out = _first(found), self._new(rows, found), []
        for id_, given in new.items():
            tries, last, seq, _, done = found.get(id_, (0, None, None, None, False))
            for at, number in sorted(given):
                if last is not None and at > last + self.patience:
                    record, done = ("given up", tries, None), True
                else:
                    tries, last, seq = tries + 1, at, number
                    ok, answer = given[at, number]
                    if ok:
                        record, done = ("answered", tries, answer), True
                    elif tries == self.tries:
                        record, done = ("failed", tries, None), True
                if done:
                    out.append((id_, *record))
                    break
            found[id_] = (tries, last, seq, last + (self.keep if done else self.patience), done)
        if new:
            self._store(found)
            self._wait(before, found)
        yield _records(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, left, out = timerValues.getCurrentWatermarkInMs(), {}, []
        for id_, (tries, last, seq, until, done) in self._load().items():
            if until - 1 > now:
                left[id_] = (tries, last, seq, until, done)
            elif not done:
                left[id_] = (tries, last, seq, until + self.keep, True)
                out.append((id_, "given up", tries, None))
            # else its record was long enough ago: the id is forgotten
        self._store(left)
        self._wait(None, left)  # the timer that has expired goes by itself
        yield _records(out)

    def close(self) -> None:
        pass


def _first(found: dict[str, tuple]) -> int | None:
    return min((s[3] for s in found.values()), default=None)


def _records(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "outcome", "attempts", "answer"]).astype({"id": object, "outcome": object, "attempts": "int32", "answer": object})


def outcomes(stream: DataFrame, tries: int = 3, patience_days: int = 365, keep_days: int = 36500, buckets: int = 1024) -> DataFrame:
    """One record an id from attempts ``id string, at timestamp, seq bigint, ok boolean, answer string``.

    ``answered`` by the first attempt that succeeds, ``failed`` after so many that didn't, ``given up`` when no further one comes
    within ``patience_days`` of the last; ``attempts`` says how many there were. An attempt is known by its time and ``seq``, and
    those of an id come in that order: one that isn't later than the last is a repeated delivery and counts for nothing, as does
    all that comes after the record. Ids with a record are forgotten ``keep_days`` later, so state is bounded by the ids of that
    time. Null ids, times and outcomes of a call are left out, for they name no attempt.

    All times are the events' own, so a stream that starts again, or other batches, give the same records; batches may part what is
    of one instant, but an attempt exactly ``patience_days`` after the last finds its id given up if that instant was in a batch before.

    Ids are dealt into ``buckets`` by their hash and a bucket's ids are handled by one call, with one state and one timer, for a call
    costs far more than an attempt. A bucket's state is written anew when one of its ids changes. The number is part of a checkpoint.
    """
    day = 86_400_000
    rows = stream.where("id IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL AND ok IS NOT NULL")
    # rows at the watermark itself are dropped: those of the latest instant may still come in the next batch
    rows = rows.withWatermark("at", "1 millisecond")
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
    rows = rows.select(bucket, "id", "at", F.unix_millis("at").alias("at_ms"), "seq", "ok", "answer")
    return rows.groupBy("bucket").transformWithStateInPandas(_Attempts(tries, patience_days * day, keep_days * day), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")


def with_rocks(start):
    """Start a query under the state store that such a state needs; the session's own setting stays as it was."""

    def inner(stream: DataFrame, *args, **named):
        conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
        before = conf.get(name, None)
        conf.set(name, ROCKS)
        try:
            return start(stream, *args, **named)
        finally:
            conf.unset(name) if before is None else conf.set(name, before)

    return inner

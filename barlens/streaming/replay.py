"""Replay of several sources, merged in event time, into a strategy whose intents depend on what its earlier ones became.

Events are (key, ts, local_ts, source, seq, kind, price, qty). They are taken in order of (ts, source, seq); one whose ``local_ts`` is before its
``ts`` comes from the future and ends the replay. An intent is filled at the key's next bar, up to a share of its volume, and what is left of it lapses.
The state of a key is small and turns into text, so a table and a stream go through the same steps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = ("ts", "local_ts", "source", "seq", "kind", "price", "qty")


class LookAheadError(ValueError):
    """An event was there before it happened."""


@dataclass(frozen=True)
class Reversion:
    """Buys a lot below and sells one above a band around the mean of the last closes; after an alert it opens nothing until the next bar is over."""

    bars: int = 5
    band: float = 0.05
    lot: float = 100.0
    most: float = 300.0

    def wanted(self, book: Book, price: float) -> float:
        """Signed quantity that the strategy asks for at a bar, from the closes before it."""
        if len(book.closes) < self.bars:
            return 0.0
        total = 0.0
        for c in book.closes:
            total += c
        mean = total / self.bars
        if price < mean * (1 - self.band) and not book.alert and book.position + self.lot <= self.most:
            return self.lot
        return -min(self.lot, book.position) if price > mean * (1 + self.band) and book.position > 0 else 0.0


@dataclass
class Book:
    """A key's state: position, cash, the open intent, the closes that the strategy looks at, and events that wait for the watermark."""

    position: float = 0.0
    cash: float = 0.0
    open: float = 0.0
    alert: bool = False
    closes: list[float] = field(default_factory=list)
    steps: int = 0
    waiting: list[list] = field(default_factory=list)

    def on(self, event: tuple, strategy: Reversion, share: float) -> list[tuple]:
        """Actions (ts, action, qty, price, position, cash) at one event."""
        ts, local_ts, _, _, kind, price, qty = event
        if local_ts < ts:
            raise LookAheadError(f"an event of {ts} was there at {local_ts}")
        if kind == "alert":
            self.alert = True
            return []
        if kind != "bar":
            raise ValueError(f"unknown kind of event {kind!r}")
        out = []
        if self.open:
            part = min(abs(self.open), float(int(share * qty)))
            filled, self.open = (part if self.open > 0 else -part), 0.0
            if filled:
                self.position, self.cash = self.position + filled, self.cash - filled * price
                out.append((ts, "fill", filled, price, self.position, self.cash))
        self.open = strategy.wanted(self, price)
        if self.open:
            out.append((ts, "intent", self.open, price, self.position, self.cash))
        self.closes = [*self.closes, price][-strategy.bars :]
        self.alert = False
        return out


def _schema(events: DataFrame) -> str:
    return f"key {events.schema['key'].dataType.simpleString()}, step long, ts long, action string, qty double, price double, position double, cash double"


def merged(**sources: DataFrame) -> DataFrame:
    """Sources by name, each with the columns of an event but ``source``, as one; of equal times the name decides."""
    parts = [df.withColumn("source", F.lit(name)).select("key", *COLUMNS) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _numbered(key, book: Book, found: list[tuple]) -> pd.DataFrame:
    rows = [(key, book.steps + i, *f) for i, f in enumerate(found)]
    book.steps += len(found)
    return pd.DataFrame(rows, columns=["key", "step", "ts", "action", "qty", "price", "position", "cash"])


def replayed(events: DataFrame, strategy: Reversion = Reversion(), share: float = 0.1) -> DataFrame:  # noqa: B008
    """Intents and fills of a whole table; a task folds its keys one after another and holds the state of one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, book = None, Book()
        for part in parts:
            out = []
            for name, own in part.groupby("key", sort=False):
                if name != key:
                    key, book = name, Book()
                found = [a for e in own[list(COLUMNS)].itertuples(index=False, name=None) for a in book.on(e, strategy, share)]
                out.append(_numbered(key, book, found))
            if out:
                yield pd.concat(out)

    ordered = events.where("key is not null").repartition("key").sortWithinPartitions("key", "ts", "source", "seq").select("key", *COLUMNS)
    return ordered.mapInPandas(run, _schema(events))


def replayed_stream(events: DataFrame, delay: str, strategy: Reversion = Reversion(), share: float = 0.1) -> DataFrame:  # noqa: B008
    """The same over a stream in which events come out of order by at most ``delay``: a key's events wait until the watermark has passed them.

    ``ts`` and ``local_ts`` are microseconds. An event that comes later than that would have changed what is already told, so it ends the replay."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = Book(**json.loads(state.get[0])) if state.exists else Book()
        passed = state.getCurrentWatermarkMs() * 1000
        for part in parts:
            for e in part[list(COLUMNS)].itertuples(index=False, name=None):
                if e[0] < passed:
                    raise LookAheadError(f"an event of {e[0]} came after the watermark {passed}")
                book.waiting.append([int(e[0]), int(e[1]), e[2], int(e[3]), e[4], float(e[5]), float(e[6])])
        book.waiting.sort(key=lambda e: (e[0], e[2], e[3]))
        ready = [e for e in book.waiting if e[0] < passed]
        book.waiting = book.waiting[len(ready) :]
        out = _numbered(key[0], book, [a for e in ready for a in book.on(tuple(e), strategy, share)])
        state.update((json.dumps(asdict(book)),))
        if book.waiting:
            state.setTimeoutTimestamp(max(book.waiting[0][0] // 1000 + 1, passed // 1000 + 1))
        yield out

    timed = events.where("key is not null").withColumn("event_time", F.timestamp_micros("ts")).withWatermark("event_time", delay)
    return timed.groupBy("key").applyInPandasWithState(step, _schema(events), "state string", "append", GroupStateTimeout.EventTimeTimeout)

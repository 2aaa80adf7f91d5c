"""Pre-trade gateway: one state for each account, the same rules over a table and over a stream.

Events are (account, seq, kind, order_id, asset, side, qty, price, ends), numbered from 1 without gaps in each account. Kinds:

* ``order``: an intent; those up to the next ``ends`` form a batch, which is judged together;
* ``fill`` and ``reject``: what became of an order that was let through; others are ignored;
* ``panic``/``calm``, ``kill``/``revive``, ``halt``/``resume``: flags; ``equity``: the account's equity, in ``price``; ``day``: a new day, which forgets the ids.

An intent is denied for the first of these that holds: panic; a number already let through; and, unless it sells, the kill flag, too many rejects among the
last outcomes, the halt after drift, a position above its share of equity; then an order above the limit; and a sale of more than is held while
the batch buys the same asset. Answers are (account, seq, order_id, allowed, reason).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import count, islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FLAGS = {"panic": ("panic", True), "calm": ("panic", False), "kill": ("kill", True), "revive": ("kill", False), "halt": ("halt", True), "resume": ("halt", False)}
COLUMNS = ("seq", "kind", "order_id", "asset", "side", "qty", "price", "ends")


@dataclass(frozen=True)
class Limits:
    max_order_value: float = 200_000.0
    max_weight: float = 0.1
    window: int = 100
    min_fill_ratio: float = 0.5


@dataclass
class Account:
    """What an account's next answer depends on. ``outcomes`` are the last ones, true for a reject; positions are (quantity, last price) by asset."""

    next_seq: int = 1
    panic: bool = False
    kill: bool = False
    halt: bool = False
    equity: float = 0.0
    sent: dict[str, bool] = field(default_factory=dict)
    outcomes: list[bool] = field(default_factory=list)
    positions: dict[str, list[float]] = field(default_factory=dict)
    waiting: list[list] = field(default_factory=list)

    def note(self, rejected: bool, limits: Limits) -> None:
        self.outcomes.append(rejected)
        del self.outcomes[: -limits.window]

    def reason(self, order_id: str, asset: str, side: str, qty: float, price: float, bought: set[str], limits: Limits) -> str:
        if self.panic:
            return "panic"
        if order_id in self.sent:
            return "duplicate"
        held, last = self.positions.get(asset, (0.0, 0.0))
        if side != "sell":
            if self.kill:
                return "kill"
            if len(self.outcomes) >= limits.window and sum(self.outcomes) / limits.window > 1 - limits.min_fill_ratio:
                return "rejects"
            if self.halt:
                return "drift"
            if self.equity > 0 and (held * last + qty * price) / self.equity > limits.max_weight:
                return "concentration"
        if qty * price > limits.max_order_value:
            return "value"
        return "self_match" if side == "sell" and qty > held and asset in bought else ""

    def judge(self, batch: list[tuple], limits: Limits) -> list[tuple[int, str, str]]:
        """(seq, order_id, reason) of the orders of a batch, in order; other events change the state alone."""
        bought = {str(e[3]) for e in batch if e[1] == "order" and e[4] == "buy"}
        out = []
        for seq, kind, order_id, asset, side, qty, price, _ in batch:
            asset = str(asset)
            if kind == "order":
                reason = self.reason(order_id, asset, side, qty, price, bought, limits)
                out.append((seq, order_id, reason))
                if not reason:
                    self.sent[order_id] = True
                    self.note(False, limits)
            elif kind in ("fill", "reject"):
                if order_id in self.sent:
                    self.note(kind == "reject", limits)
                    if kind == "fill":
                        held = self.positions.get(asset, (0.0, 0.0))[0]
                        self.positions[asset] = [held + qty if side == "buy" else held - qty, price]
            elif kind == "equity":
                self.equity = price
            elif kind == "day":
                self.sent.clear()
            elif kind in FLAGS:
                setattr(self, *FLAGS[kind])
            else:
                raise ValueError(f"unknown kind of event {kind!r}")
        return out

    def take(self, events: list[tuple], limits: Limits) -> list[tuple[int, str, str]]:
        """Answers to whatever whole batches the events complete; the rest waits, in any order of arrival. A number that was judged before is ignored."""
        if self.waiting or any(e[0] != n for e, n in zip(events, count(self.next_seq))):  # else they are the next ones, in order
            events = sorted({e[0]: list(e) for e in [*self.waiting, *events] if e[0] >= self.next_seq}.values())
        out, batch, done = [], [], 0
        for e in events:
            if e[0] != self.next_seq + len(batch):
                break
            batch.append(tuple(e))
            if e[7]:
                out += self.judge(batch, limits)
                self.next_seq += len(batch)
                done += len(batch)
                batch = []
        self.waiting = [list(e) for e in events[done:]]
        return out


def _rows(events: pd.DataFrame) -> list[tuple]:
    return [(int(s), k, None if pd.isna(o) else o, None if pd.isna(a) else str(a), d, float(q), float(p), bool(e)) for s, k, o, a, d, q, p, e in zip(*(events[c] for c in COLUMNS), strict=True)]


def _schema(events: DataFrame) -> str:
    return f"account {events.schema['account'].dataType.simpleString()}, seq long, order_id string, allowed boolean, reason string"


def _answers(account, found: list[tuple[int, str, str]]) -> pd.DataFrame:
    return pd.DataFrame([(account, seq, order_id, not reason, reason) for seq, order_id, reason in found], columns=["account", "seq", "order_id", "allowed", "reason"])


def _columns(events: pa.RecordBatch) -> Iterator[tuple]:
    """The same from an Arrow batch, without pandas."""
    of = {c: events.column(c) for c in COLUMNS}
    of["asset"] = pc.cast(of["asset"], pa.string())
    for c in ("qty", "price"):
        of[c] = pc.fill_null(pc.cast(of[c], pa.float64()), float("nan"))
    # Whole arrays at once: to_pylist makes an object of Arrow's of each value first.
    return zip(*(of[c].to_numpy(zero_copy_only=False).tolist() for c in COLUMNS), strict=True)


def judged(events: DataFrame, limits: Limits = Limits(), ordered: bool = False) -> DataFrame:  # noqa: B008
    """Answers to a whole table. A task reads its accounts' events in order and holds one account's state and batch, so no account is collected.

    ``ordered``: each account's events lie in one partition in the order of their numbers, as the window that numbered them leaves them, and are not shuffled again."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account = state = None
        for part in parts:
            names, out, rows, at = [], [], _columns(part), 0
            runs = pc.run_end_encode(part.column("account"))
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if name != account:
                    account, state = name, Account()
                found = state.take(list(islice(rows, end - at)), limits)
                names += [name] * len(found)
                out += found
                at = end
            seq, order_id, reason = zip(*out, strict=True) if out else ((), (), ())
            columns = [pa.array(names, part.schema.field("account").type), pa.array(seq, pa.int64()), pa.array(order_id, pa.string()), pa.array([not r for r in reason], pa.bool_()), pa.array(reason, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["account", "seq", "order_id", "allowed", "reason"])

    placed = events.where("account is not null").select("account", *COLUMNS)
    if not ordered:
        placed = placed.repartition("account").sortWithinPartitions("account", "seq")
    return placed.mapInArrow(run, _schema(events))


def judged_stream(events: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The same over a stream, whatever way events fall into micro-batches: an account's state waits for the next number. It is kept in the
    checkpoint, as text, so a restart goes on where the last micro-batch ended."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        account = Account(**json.loads(state.get[0])) if state.exists else Account()
        found = account.take([r for part in parts for r in _rows(part)], limits)
        state.update((json.dumps(asdict(account)),))
        yield _answers(key[0], found)

    return events.select("account", *COLUMNS).groupBy("account").applyInPandasWithState(step, _schema(events), "state string", "append", GroupStateTimeout.NoTimeout)

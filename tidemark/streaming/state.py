"""State of one symbol in a stream: last close, smoothed range, condition, open windows and last exit.

Needs Spark's RocksDB state store (``tidemark.session.tuned`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.numeric import EPSILON

BAR = "struct<micros:long,open:double,high:double,low:double,close:double,condition:boolean,event:boolean>"
STATE = (f"waiting array<{BAR}>, recent array<{BAR}>, seen long, atr double, last_exit long, timer long")
# Times are microseconds since the epoch throughout; the jobs convert them.
SERIES_SCHEMA = ("micros long, ticker string, position long, dip_event_v1 boolean, atr double, "
                 "trade struct<status:string,entry_micros:long,entry_price:double,exit_micros:long,exit_price:double,"
                 "exit_reason:string,fill_type:string,holding_bars:long,ambiguous_bar:boolean>")
ANSWER = Row("micros", "ticker", "position", "dip_event_v1", "atr", "trade")
TRADE = Row("status", "entry_micros", "entry_price", "exit_micros", "exit_price", "exit_reason", "fill_type", "holding_bars", "ambiguous_bar")
AT, OPEN, HIGH, LOW, CLOSE, CONDITION, EVENT = range(7)


def reached(value: float, level: float | None, above: bool) -> bool:
    """Whether a price touches a level, up to rounding; the scalar twin of ``numeric.touches``."""
    if level is None:
        return False
    slack = 8 * EPSILON * max(abs(value), abs(level))
    return value >= level - slack if above else value <= level + slack


def first_touch(bars: list[tuple], lower: float | None, upper: float | None) -> tuple[str, float, str, int, bool]:
    """Reason, price, fill, bars held and whether both barriers lie in the exit bar; the stop comes first."""
    for held, bar in enumerate(bars, 1):
        low, high = reached(bar[LOW], lower, False), reached(bar[HIGH], upper, True)
        if reached(bar[OPEN], lower, False):
            return "stop_loss", bar[OPEN], "open", held, False
        if reached(bar[OPEN], upper, True):
            return "take_profit", bar[OPEN], "open", held, False
        if low:
            return "stop_loss", lower, "barrier", held, high
        if high:
            return "take_profit", upper, "barrier", held, False
    return "time_exit", bars[-1][CLOSE], "close", len(bars), False


@dataclass
class Series:
    """``waiting`` holds rows the watermark has not passed, ``recent`` the last rows taken, as many as a window needs."""

    waiting: list[tuple] = field(default_factory=list)
    recent: list[tuple] = field(default_factory=list)
    seen: int = 0
    atr: float | None = None
    last_exit: int = -1
    timer: int | None = None


class SeriesProcessor(StatefulProcessor):
    """One value of state per symbol; its size is bounded by the watermark's delay and by ``holding``."""

    def __init__(self, *, window: int = 14, holding: int = 1, stop: float | None = None, target: float | None = None,
                 idle: timedelta = timedelta(days=30), ordered: bool = False):
        self.window, self.holding, self.stop, self.target, self.ordered = window, holding, stop, target, ordered
        self.idle = idle // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = self._load()
        s.waiting += [(r.micros, r.open, r.high, r.low, r.close, bool(r.dip_condition_v1), False) for r in rows]
        yield from self._advance(key[0], s, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.state.exists():
            yield from self._advance(key[0], self._load(), timerValues)

    def close(self) -> None:
        pass

    def _load(self) -> Series:
        if not self.state.exists():
            return Series()
        waiting, recent, *rest = self.state.get()
        return Series([tuple(r) for r in waiting], [tuple(r) for r in recent], *rest)

    def _advance(self, ticker: str, s: Series, timer_values: Any) -> Iterator[Row]:
        """Take all rows the watermark has passed; without event time, all rows there are."""
        now = timer_values.getCurrentWatermarkInMs() * 1000 if self.ordered else None
        ready = sorted((r for r in s.waiting if now is None or r[AT] <= now), key=lambda r: r[AT])
        s.waiting = [r for r in s.waiting if now is not None and r[AT] > now]
        for row in ready:
            if not self.ordered or not s.recent or row[AT] > s.recent[-1][AT]:
                yield from self._take(ticker, s, row)
        if self.ordered:
            if s.recent and not s.waiting and s.recent[-1][AT] + self.idle <= now:
                yield from self._closed(ticker, s)
                self.state.clear()
                return
            # Timers have milliseconds; rounded up, they never come too soon.
            due = -(-(min(r[AT] for r in s.waiting) if s.waiting else s.recent[-1][AT] + self.idle) // 1000)
            if due != s.timer:
                self.handle.registerTimer(due)
                s.timer = due
        self.state.update((s.waiting, s.recent, s.seen, s.atr, s.last_exit, s.timer))

    def _take(self, ticker: str, s: Series, row: tuple) -> Iterator[Row]:
        before = s.recent[-1] if s.recent else None
        if before:
            span = max(row[HIGH] - row[LOW], abs(row[HIGH] - before[CLOSE]), abs(row[LOW] - before[CLOSE]))
            # The first ``window`` spans are averaged, later ones smoothed in.
            s.atr = span if s.atr is None else s.atr + (span - s.atr) / min(s.seen, self.window)
        event = row[CONDITION] and not (before and before[CONDITION])
        s.recent = [*s.recent[-self.holding:], (*row[:EVENT], event)]
        s.seen += 1
        yield ANSWER(row[AT], ticker, s.seen - 1, event, s.atr if s.seen > self.window else None, None)
        if len(s.recent) > self.holding and self.ordered:
            yield from self._decided(ticker, s, 0)

    def _decided(self, ticker: str, s: Series, at: int) -> Iterator[Row]:
        """The trade of the event at place ``at`` of the recent rows, if there is one."""
        signal, path = s.recent[at], s.recent[at + 1:at + 1 + self.holding]
        if not signal[EVENT]:
            return
        position = s.seen - len(s.recent) + at
        trade = (None,) * 7 + (False,)
        if position + 1 <= s.last_exit:
            status = "overlap"
        elif not path:
            status = "no_next_bar"
        elif len(path) < self.holding:
            status = "incomplete_window"
        else:
            status, entry = "completed", path[0][OPEN]
            reason, price, fill, held, both = first_touch(path, None if self.stop is None else entry * (1 - self.stop),
                                                          None if self.target is None else entry * (1 + self.target))
            s.last_exit = position + held
            trade = (path[0][AT], entry, path[held - 1][AT], price, reason, fill, held, both)
        yield ANSWER(signal[AT], ticker, position, True, None, TRADE(status, *trade))

    def _closed(self, ticker: str, s: Series) -> Iterator[Row]:
        """Trades of the events whose windows were still open."""
        for at in range(max(len(s.recent) - self.holding, 0), len(s.recent)):
            yield from self._decided(ticker, s, at)

"""State per key for rows in order, with late rows set aside instead of applied or lost.

A row is late when its key has already applied a later one. No watermark filters the input, so every late
row reaches its key and leaves with the reason in ``set_aside``; writers part the two
(``runtime.run_split``). Within a micro-batch the rows of a key are put in order first. Keys are many and
have few rows each, so they are handled row by row, without a table of their own. State lives in the
state store with an optional time to live, after which a key that gets no rows is forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LATE, NO_TIME = "late", "no time"
#: Settings of the runs: the store that holds state with a time to live, and no batch without data.
STORE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STATE_SETTINGS = {**STORE_SETTINGS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@dataclass(frozen=True)
class Rule:
    """What a key keeps and what a row gives.

    ``step(kept, row)`` takes the kept values (None for a new key) and the values of ``reads``; it returns
    the values to keep and the results, none or several tuples of ``result``. With ``slack`` a row is late
    only when it is more than that behind the latest row of its key. ``load`` and ``save`` turn stored
    values into what ``step`` works on and back, once per micro-batch.
    """

    state: str
    result: str
    reads: tuple[str, ...]
    step: Callable
    slack: float | None = None
    load: Callable = field(default=lambda kept: kept)
    save: Callable = field(default=lambda kept, seen: kept)


class _InOrder(StatefulProcessor):
    def __init__(self, rule: Rule, keys: tuple[str, ...], order: tuple[str, str], columns: list[str], keep_ms: int | None):
        self.rule, self.keys, self.order, self.columns, self.keep_ms = rule, keys, order, columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", f"seen double, seen_id long, {self.rule.state}", self.keep_ms)

    def _late(self, at: tuple, seen: tuple) -> bool:
        return at <= seen if self.rule.slack is None else at[0] < seen[0] - self.rule.slack

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.kept.get()
        seen = (stored[0], stored[1]) if stored else (float("-inf"), -1)
        kept = self.rule.load(tuple(stored[2:])) if stored else None
        none = (None,) * (len(self.columns) - len(self.keys) - 3)
        found_rows, timed = [], []
        for r in rows:
            t, number = (r[c] for c in self.order)
            if t is None or number is None or t != t:
                found_rows.append((*key, None if t != t else t, number, *none, NO_TIME))
            else:
                timed.append((t, number, *(r[c] for c in self.rule.reads)))
        for t, number, *row in sorted(timed, key=itemgetter(0, 1)):
            head = (*key, t, number)
            if self._late((t, number), seen):
                found_rows.append((*head, *none, LATE))
            else:
                kept, found = self.rule.step(kept, (t, number, *row))
                seen = max(seen, (t, number))
                found_rows += [(*head, *f, None) for f in found]
        if kept is not None:
            self.kept.update((*seen, *self.rule.save(kept, seen)))
        named = Row(*self.columns)
        yield from (named(*r) for r in found_rows)

    def close(self) -> None:
        pass


def _names(ddl: str) -> list[str]:
    """Column names of a DDL string without nested commas."""
    return [x.split()[0] for x in ddl.split(",")]


def in_order(rows: DataFrame, keys: tuple[str, ...], rule: Rule, order: tuple[str, str] = ("t", "event_id"), keep_ms: int | None = None) -> DataFrame:
    """Keys, order, results and ``set_aside`` (null, ``late`` or ``no time``) of a stream of rows.

    ``order`` is a double and a long. ``keep_ms`` is the time, by the clock of the cluster, for which a key
    is kept without new rows; a key that comes back later starts anew. Null keys are a key of their own.
    """
    kinds = dict(rows.dtypes)
    head = [*keys, *order]
    columns = [*head, *_names(rule.result), "set_aside"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in head), rule.result, "set_aside string"])
    d = rows.select(*dict.fromkeys([*head, *rule.reads]))
    return d.groupBy(*keys).transformWithState(_InOrder(rule, keys, order, columns, keep_ms), schema, "append", "ProcessingTime")

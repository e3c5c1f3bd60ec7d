"""Stitch a stream of answered batches: one state a document, holding its open unit, its counters and what came too early."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.operators.stitch import Stitcher, TextWindow, restored, state_of
from spanloom.plans.engine import UNIT_FIELDS, batch_units, names_of, unit_row

#: Status of a row that tells of a batch that did not come; its sequence is the batch's number.
MISSING = "missing"
#: Seconds that a document waits for its next batch, and that its end is remembered.
WAIT_S, REMEMBER_S = 3600, 7 * 86400
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ("chunk_id", "char_start", "char_end", "text", "payload_json", "is_last")


class Stitching(StatefulProcessor):
    """The fold over a document's batches as they come.

    State: the open unit with the text since it began and the counters, a value; batches that wait for one before
    them, a map by number; and that the document has ended, a value that is forgotten after a time. While a
    document is not at its end, a timer runs from its last batch on.
    """

    def __init__(self, keep_lone_ends: bool, wait_s: float, remember_s: float, key: str):
        self.keep_lone_ends, self.wait_ms, self.remember_ms, self.key = keep_lone_ends, int(wait_s * 1000), int(remember_s * 1000), key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "fold string, base long, text string, k int, next long, at long")
        self.held = handle.getMapState("held", "chunk_id long", "char_start long, char_end long, text string, payload_json string, is_last boolean")
        self.ended = handle.getValueState("ended", "n long", self.remember_ms)

    def _state(self) -> tuple[Stitcher, TextWindow, int, int, int]:
        """The fold, its text, the next k, the number of the next batch, and where the last one ended."""
        fold, base, text, k, turn, at = self.open.get() if self.open.exists() else (None, 0, "", 0, 1, 0)
        window = TextWindow(base, text)
        return restored(window, json.loads(fold) if fold else None), window, k, turn, at

    def _went_on(self, key: object, fold: Stitcher, window: TextWindow, k: int, turn: int, at: int, over: bool, now: int) -> list[dict]:
        """Keep the state, or end the document; the rows of what was finished."""
        if over:
            fold.finish(at)
        rows = [unit_row(k + i, u) | {"doc_id": key} for i, u in enumerate(fold.units)]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if over:
            self.open.clear()
            self.held.clear()
            self.ended.update((turn,))
        else:
            since = fold.pending.unit.start if fold.pending else at
            text = window.text[max(since - window.base, 0) :]
            self.open.update((json.dumps(state_of(fold), ensure_ascii=False), since, text, k + len(rows), turn, at))
            self.handle.registerTimer(now + self.wait_ms)
        return rows

    def _taken(self, fold: Stitcher, window: TextWindow, turn: int, at: int) -> tuple[int, int, bool]:
        """Fold in the batches whose turn it is."""
        while self.held.containsKey((turn,)):
            a, b, text, payload, last = self.held.getValue((turn,))
            self.held.removeKey((turn,))
            window.text = window.text[: a - window.base].ljust(a - window.base, "\n") + text
            units, _, _ = batch_units(payload, text, a, self.keep_lone_ends)
            fold.add(units, turn, a, b)
            turn, at = turn + 1, b
            if last:
                return turn, at, True
            since = fold.pending.unit.start if fold.pending else at
            window.text, window.base = window.text[max(since - window.base, 0) :], since
        return turn, at, False

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's names
        if self.ended.exists():  # a batch that comes again behind the end is passed over
            for _ in rows:
                pass
            return
        fold, window, k, turn, at = self._state()
        for frame in rows:
            for c in frame.to_dict("records"):
                n = int(c["chunk_id"])
                if n >= turn and not self.held.containsKey((n,)):
                    self.held.updateValue((n,), (int(c["char_start"]), int(c["char_end"]), c["text"], c["payload_json"], bool(c["is_last"])))
        turn, at, over = self._taken(fold, window, turn, at)
        yield _frame(self._went_on(key[0], fold, window, k, turn, at, over, timerValues.getCurrentProcessingTimeInMs()), self.key)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        fold, window, k, turn, at = self._state()
        later = sorted(x[0] for x in self.held.keys())
        told = [{"doc_id": key[0], "k": -1, "sequence": n, "status": MISSING} for n in (range(turn, later[0]) if later else [turn])]
        if later:
            turn, at, over = self._taken(fold, window, later[0], at)
        else:
            over = True
        rows = self._went_on(key[0], fold, window, k, turn, at, over, timerValues.getCurrentProcessingTimeInMs())
        none = dict.fromkeys(names_of(UNIT_FIELDS))
        yield _frame([none | t for t in told], self.key).astype(object)
        yield _frame(rows, self.key)


def _frame(rows: list[dict], key: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", *names_of(UNIT_FIELDS)]).rename(columns={"doc_id": key})


def stitch_stream(calls: DataFrame, keep_lone_ends: bool = True, wait_s: float = WAIT_S, remember_s: float = REMEMBER_S) -> DataFrame:
    """Units as they are finished, from a stream of batches.

    ``calls`` has doc_id, chunk_id (1, 2, 3, … in each document), char_start, char_end, text (the
    batch's), payload_json and is_last. Batches that come before their turn are held until
    the ones before them are there; a batch that comes again is passed over. The last
    one flushes the open unit, whose k counts from 0 in each document, and ends the document: for ``remember_s``
    seconds batches that come again are passed over.

    A document that waits for ``wait_s`` seconds tells what it waits for, in rows with the status ``missing`` and the batch's
    number as sequence. Then it goes on with the batches that it holds; if there are none, it ends as it is.
    Typed state needs the RocksDB state store, which is set in the session.
    """
    spark, kind = calls.sparkSession, calls.schema["doc_id"].dataType.simpleString()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    made = Stitching(keep_lone_ends, wait_s, remember_s, "doc_id")
    grouped = calls.select("doc_id", *_FIELDS).groupBy("doc_id")
    return grouped.transformWithStateInPandas(made, f"doc_id {kind}, {UNIT_FIELDS}", "Append", "ProcessingTime")

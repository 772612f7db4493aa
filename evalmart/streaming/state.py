"""Keyed state of the streaming jobs: what a batch costs depends on its own rows, not on the batches before it.

State lives in the RocksDB store of the checkpoint, so a restart goes on where the last committed batch ended, and a batch
that is replayed starts from the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def _micros(amount) -> int:
    return int(Decimal(str(amount)) * MICROS)


class SpendState(StatefulProcessor):
    """Spend and last ordinal of a run; yields a row per crossed step and flags the row that reaches the limit.

    Rows of one batch are taken in ``seq`` order as two integers each; what was spent before is one value.
    """

    def __init__(self, step, limit):
        self.step, self.limit = _micros(step), _micros(limit)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "micros decimal(38,0), last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [f[["seq", "micros"]] for f in rows]
        batch = pd.concat(frames).sort_values("seq", kind="stable")
        before, last = self.spent.get() if self.spent.exists() else (Decimal(0), None)
        seq, costs = batch["seq"].to_numpy(np.int64), batch["micros"].to_numpy(np.int64)
        after = int(before) + np.cumsum(costs)
        earlier = after - costs
        newest = int(seq[-1]) if last is None else max(int(last), int(seq[-1]))
        self.spent.update((Decimal(int(after[-1])), newest))
        tripped = (self.limit > 0) & (earlier < self.limit) & (after >= self.limit)
        low, high = earlier // self.step, after // self.step
        out = []
        for i in np.flatnonzero((high > low) | tripped).tolist():
            for bucket in range(int(low[i]) + 1, int(high[i]) + 1) or [None]:
                out.append((key[0], int(seq[i]), bucket, Decimal(int(after[i])) / MICROS, bool(tripped[i])))
        if out:
            made = pd.DataFrame(out, columns=["run_id", "seq", "bucket", "spent", "tripped"])
            yield made.astype({"bucket": "Int64"})

    def close(self) -> None:
        pass


class NewestState(StatefulProcessor):
    """Highest ordinal committed under a key; yields the newest record of a batch if it is newer than that."""

    def __init__(self, columns: Sequence[str], seq: str):
        self.columns, self.seq = list(columns), seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.committed = handle.getValueState("committed", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            frame = frame.set_axis(self.columns, axis=1)  # names with a leading underscore arrive under others
            head = frame.loc[[frame[self.seq].idxmax()]] if len(frame) else None
            if head is not None and (best is None or head[self.seq].iloc[0] > best[self.seq].iloc[0]):
                best = head
        if best is None:
            return
        seq = int(best[self.seq].iloc[0])
        if not self.committed.exists() or seq > self.committed.get()[0]:
            self.committed.update((seq,))
            yield best

    def close(self) -> None:
        pass


class TrialState(StatefulProcessor):
    """Newest result, case and budget record of a trial; yields the codes of its result whenever one of them has moved.

    With ``patience`` a missing record is reported when the timer of its result ends, and at once without.
    """

    SIDES = ("result", "case", "budget")

    def __init__(self, fields: Sequence[str], patience_ms: int | None):
        self.fields, self.patience = list(fields), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sides = handle.getMapState("sides", "side string", "seq bigint, there boolean, row array<string>")
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple] = {}
        for frame in rows:
            for side, own in frame.groupby("side"):
                at = own["seq"].idxmax()
                seq = int(own.at[at, "seq"])
                if side not in newest or seq > newest[side][0]:
                    newest[side] = (seq, bool(own.at[at, "there"]), list(own.at[at, "row"]))
        for side, value in newest.items():
            held = self.sides.getValue((side,))
            if held is None or value[0] >= held[0]:
                self.sides.updateValue((side,), value)
        if "result" in newest:
            self._forget_timer()
        yield from self._judged(key, timerValues.getCurrentProcessingTimeInMs() if self.patience is not None else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.update((0,))  # the wait is over until another result comes
        yield from self._judged(key, None)

    def _forget_timer(self) -> None:
        if self.due.exists():
            if self.due.get()[0] > 0:
                self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def _judged(self, key, now: int | None) -> Iterator[pd.DataFrame]:
        result, case, budget = (self._side(s) for s in self.SIDES)
        if result is None:
            return
        codes = []
        if result[1]:
            missing = [f"missing_{name}" for name, side in (("case", case), ("budget", budget)) if side is None]
            if missing and now is not None and not self.due.exists():
                self.handle.registerTimer(now + self.patience)
                self.due.update((now + self.patience,))
            codes += missing if now is None or self.due.get()[0] <= now else []
            if case is not None and case[2][0] != result[2][0]:
                codes.append("case_task_id")
            if budget is not None:
                codes += [f"budget_{f}" for f, mine, theirs in zip(self.fields, result[2][1:], budget[2][1:], strict=True) if mine != theirs]
        yield pd.DataFrame({"key": [key[0]], "seq": [result[0]], "codes": [codes]})

    def _side(self, side: str):
        value = self.sides.getValue((side,))
        return value if value is None or side == "result" or value[1] else None

    def close(self) -> None:
        pass

"""The tool environment on a stream: cases in groups, calls folded in their order once the watermark has passed them."""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.environment import CALL
from palimpsest.operators.frames import importable

#: Of a group of cases: what each case is at, the calls that wait (both pickled), and when its one timer goes off.
STATE = "cases binary, waiting binary, due long"
OUT = "n long, tool string, code string, status string, finalized boolean"


def take_call(state: tuple, call: Any) -> tuple[tuple, str]:
    """(state after the call, code), as `environment.fold` has it for one call; state: status, finalized, selects a stale policy."""
    status, finalized, stale = state
    shut = ("already_finalized" if call.finalizes else "case_finalized") if call.mutates and finalized else None
    code = call.gate or shut or call.domain_error or ("expired_policy_action" if call.rests and stale else None) or call.late_error or "ok"
    if code == "ok":
        state = (call.effect or status, bool(finalized or call.finalizes), stale if call.selects_stale is None else bool(call.selects_stale))
    return state, code


class CaseFold(StatefulProcessor):
    """Calls of a group of cases wait until a timer says that the watermark has passed the first; then all that it has passed are folded in order.

    So calls that come late, but before the watermark, are folded in their place; what the watermark has passed is dropped by Spark. A
    finalized case is forgotten `keep_ms` after its last call, unless calls of it wait. Each use of the state costs a call to the JVM, some
    milliseconds in all for a group and batch; so cases are kept in groups, whose state is read and written as one.
    """

    def __init__(self, key: str, order: list[str], keep_ms: int):
        self.key, self.order, self.keep_ms = key, order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", STATE)
        self.call = namedtuple("Call", ["case", "call_ms", *(f"order_{i}" for i in range(len(self.order))), "tool", *CALL])

    def held(self) -> tuple[dict, list, int | None]:
        """Of each case (status, finalized, stale, n, when its last call was), the calls that wait, and the timer."""
        cases, waiting, due = self.state.get() if self.state.exists() else (None, None, None)
        return pickle.loads(cases) if cases else {}, pickle.loads(waiting) if waiting else [], due  # noqa: S301

    def hold(self, cases: dict, waiting: list, due: int | None) -> None:
        if cases or waiting:
            self.state.update((pickle.dumps(cases), pickle.dumps(waiting), due))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
        import pandas as pd

        cases, waiting, due = self.held()
        for part in rows:
            part = part[[self.key, "call_ms", *self.order, "tool", *CALL]].astype(object)
            waiting += part.where(pd.notna(part), None).itertuples(index=False, name=None)
        first = min(int(c[1]) for c in waiting)
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            due = first
            self.handle.registerTimer(due)
        self.hold(cases, waiting, due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: ANN001, N802, N803
        import pandas as pd

        now = max(int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs()))
        cases, waiting, _ = self.held()
        rest, out = [c for c in waiting if c[1] > now], []
        for c in sorted((c for c in waiting if c[1] <= now), key=lambda c: [(v is None, v) for v in c[1 : 2 + len(self.order)]]):
            call = self.call(*c)
            *state, n, last = cases.get(call.case, ("open", False, False, 0, 0))
            state, code = take_call(tuple(state), call)
            cases[call.case] = (*state, n + 1, max(last, int(call.call_ms)))
            out.append((call.case, n + 1, call.tool, code, state[0], state[1]))
        wait = {c[0] for c in rest}
        ends = {k: v[4] + self.keep_ms for k, v in cases.items() if v[1] and k not in wait}
        for k in [k for k, end in ends.items() if end <= now]:
            del cases[k], ends[k]
        due = min([int(c[1]) for c in rest] + [*ends.values()], default=None)
        if due is not None:
            self.handle.registerTimer(due)
        self.hold(cases, rest, due)
        if out:
            yield pd.DataFrame(out, columns=[self.key, *(c.split()[0] for c in OUT.split(", "))])

    def close(self) -> None:
        pass


def fold_stream(calls: DataFrame, key: str, at: str, order: list[str], late: str = "1 hour", keep_ms: int = 30 * 86_400_000, groups: int = 512) -> DataFrame:
    """As `environment.fold` on a stream of calls: key, n, tool, code, status and finalized of each call, once the watermark has passed it.

    `at` is the time of a call; calls of a case are folded by it, then by `order`. Rows later than `late` behind the latest are dropped,
    and a finalized case's state goes `keep_ms` after its last call. A case's group is by its key's hash; a group's cases and waiting
    calls are in a task's memory, and `groups` stays as it is while a checkpoint is used. Needs the RocksDB state store.
    """
    importable(calls.sparkSession)
    kinds = dict(calls.dtypes)
    rows = calls.select(key, F.col(at).cast("timestamp").alias("call_time"), *order, "tool", *CALL).withWatermark("call_time", late)
    rows = rows.withColumns({"call_ms": F.unix_millis("call_time"), "case_group": F.pmod(F.xxhash64(key), F.lit(groups))})
    return rows.groupBy("case_group").transformWithStateInPandas(CaseFold(key, order, keep_ms), f"{key} {kinds[key]}, {OUT}", "Append", "EventTime")

"""Stateful streams.

State per key is bounded by the limits it enforces. The events of a key are handled in time order
within a micro-batch, whose size the source bounds (``maxFilesPerTrigger`` or ``maxBytesPerTrigger``).
Rows go to the ledgers one by one, not as a frame per key: most keys have a handful of events, and a frame
costs far more than they do. Events without a time have no place in the order; they change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskspark.streaming.events import CHALLENGE_SECONDS, ISSUE_WINDOW_SECONDS, MAX_ISSUES_PER_WINDOW

# Fixed value.
MAX_LIVE = 128
CHALLENGE_OUTPUT = "manager string, event_id bigint, challenge_id string, at bigint, outcome string, live int"
APPROVAL_OUTPUT = "approval_key string, event_id bigint, entry_id string, at bigint, outcome string"
_CHALLENGE_ROW = Row("manager", "event_id", "challenge_id", "at", "outcome", "live")
_APPROVAL_ROW = Row("approval_key", "event_id", "entry_id", "at", "outcome")
UNDATED = "undated"


def _ordered(rows: Iterator[Row]) -> list[Row]:
    """By time and event, those without a time first and those without an event last."""
    return sorted(rows, key=lambda r: (r.at is not None, r.at or 0, r.event_id is None, r.event_id or 0))


class ChallengeLedger(StatefulProcessor):
    """Issues and consumptions of one manager: capacity, rate, single use and expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "challenge_id string", "expires double, consumed boolean")
        self.issued = handle.getListState("issued", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {k[0]: (v[0], v[1]) for k, v in self.live.iterator()}
        live = dict(before)
        issued = [row[0] for row in self.issued.get()]
        for row in _ordered(rows):
            if row.at is None:
                yield _CHALLENGE_ROW(key[0], row.event_id, row.challenge_id, None, UNDATED, len(live))
                continue
            now = row.at / 1e6
            known = live.get(row.challenge_id)
            if row.action == "consume" and known is not None and now >= known[0]:
                outcome = "expired"
            else:
                outcome = None
            live = {c: v for c, v in live.items() if v[0] > now}
            issued = [at for at in issued if at > now - ISSUE_WINDOW_SECONDS]
            if row.action == "issue":
                if len(live) >= MAX_LIVE:
                    outcome = "capacity"
                elif len(issued) >= MAX_ISSUES_PER_WINDOW:
                    outcome = "rate_limited"
                else:
                    live[row.challenge_id] = (now + CHALLENGE_SECONDS, False)
                    issued.append(now)
                    outcome = "issued"
            elif outcome is None:
                record = live.get(row.challenge_id)
                if record is None:
                    outcome = "unknown"
                elif record[1]:
                    outcome = "replayed"
                else:
                    live[row.challenge_id] = (record[0], True)
                    outcome = "consumed"
            yield _CHALLENGE_ROW(key[0], row.event_id, row.challenge_id, row.at, outcome, len(live))
        for challenge in before.keys() - live.keys():
            self.live.removeKey((challenge,))
        for challenge, value in live.items():
            if before.get(challenge) != value:
                self.live.updateValue((challenge,), value)
        if issued:
            self.issued.put([(at,) for at in issued])
        else:  # a list state cannot hold an empty list
            self.issued.clear()

    def close(self) -> None:
        pass


class ApprovalLedger(StatefulProcessor):
    """Current approval of one identity and scope, changed by approve and revoke events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "entry_id string, version int, expires double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.current.get()
        before = current = tuple(before) if before is not None else None
        for row in _ordered(rows):
            if row.at is None or (row.action == "approve" and row.until is None):
                yield _APPROVAL_ROW(key[0], row.event_id, row.entry_id, row.at, UNDATED)
                continue
            live = current if current is not None and current[2] > row.at / 1e6 else None
            if row.action == "approve":
                if live is not None:
                    outcome = "already-approved"
                else:
                    current, outcome = (row.entry_id, 1, row.until / 1e6), "approved"
            elif live is None or live[0] != row.entry_id:
                outcome = "not-found"
            elif row.expected_version != live[1]:
                outcome = "version-conflict"
            else:
                current, outcome = None, "revoked"
            yield _APPROVAL_ROW(key[0], row.event_id, row.entry_id, row.at, outcome)
        if current is not None and current != before:
            self.current.update(current)
        elif current is None and before is not None:
            self.current.clear()

    def close(self) -> None:
        pass


def _at(column: str, name: str):
    return F.unix_micros(F.col(column).cast("timestamp")).alias(name)


def stream_state_machine(events: DataFrame) -> DataFrame:
    """T8. ``events`` has ``manager, event_id, challenge_id, action (issue/consume), ts``."""
    rows = events.select("manager", "event_id", "challenge_id", "action", _at("ts", "at"))
    out = rows.groupBy("manager").transformWithState(
        statefulProcessor=ChallengeLedger(), outputStructType=CHALLENGE_OUTPUT, outputMode="Append", timeMode="None"
    )
    return out.select("manager", "event_id", "challenge_id", F.timestamp_micros("at").alias("ts"), "outcome", "live")


def stream_approvals(events: DataFrame) -> DataFrame:
    """T10. ``events`` has ``approval_key, event_id, entry_id, action, ts, expires_at, expected_version``."""
    rows = events.select(
        "approval_key", "event_id", "entry_id", "action", _at("ts", "at"), _at("expires_at", "until"), "expected_version"
    )
    out = rows.groupBy("approval_key").transformWithState(
        statefulProcessor=ApprovalLedger(), outputStructType=APPROVAL_OUTPUT, outputMode="Append", timeMode="None"
    )
    return out.select("approval_key", "event_id", "entry_id", F.timestamp_micros("at").alias("ts"), "outcome")

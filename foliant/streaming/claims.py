"""Keyed streaming state of documents: locks, attempts and lock expiry.

Three kinds of events meet in the state of their document: registrations, jobs and outcomes of earlier claims.
The state answers with claims, refusals and expired locks; it remembers one small row per document, and a
micro-batch touches only the rows of its own events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.options import DEFAULTS, Options
from foliant.vocab import ATTEMPTS_EXCEEDED

EVENT = ("kind string, doc_id bigint, at timestamp, status string, title string, document_type string, file_name string, file_id bigint, "
         "user_id bigint, lock_id string, value string")
DECISION = ("kind string, doc_id bigint, status string, title string, document_type string, file_name string, file_id bigint, user_id bigint, "
            "attempts int, lock_id string, lock_expires timestamp, error_message string, value string")
_STATE = ("doc_id bigint, status string, attempts int, lock_id string, lock_expires bigint, title string, document_type string, file_name string, "
          "file_id bigint, user_id bigint")
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]
#: Malformed messages have no document; they are dealt over so many keys.
_LOST_KEYS = 64


class Claims(StatefulProcessor):
    """One document's events to decisions.

    A job claims its document when it is known, neither Ready nor Blocked, unlocked and short of attempts.  The
    lock ends with the outcome that names it, or by the timer.  The clock is the time of the micro-batch, so a
    replayed batch decides alike.
    """

    def __init__(self, options: Options = DEFAULTS) -> None:
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        document = dict(zip(_FIELDS, self.state.get(), strict=True)) if self.state.exists() else None
        registered = job = None
        outcomes = {}
        for row in rows:  # a document queued very often leaves its earliest job and its newest registration
            if row.kind == "lost":
                yield self._decision("lost", value=row.value)
            elif row.kind == "registered":
                registered = row if registered is None or row.at >= registered.at else registered
            elif row.kind == "outcome":
                outcomes[row.lock_id] = row
            elif job is None or (row.at is not None and (job.at is None or row.at < job.at)):
                job = row
        if document and document["lock_id"] in outcomes:
            self._unlock(document)
            document["status"] = outcomes[document["lock_id"]].status
            document["lock_id"] = document["lock_expires"] = None
        if registered is not None and (document is None or document["lock_id"] is None):
            document = {"doc_id": registered.doc_id, "status": registered.status, "attempts": 0, "lock_id": None, "lock_expires": None,
                        **{c: registered[c] for c in ("title", "document_type", "file_name", "file_id", "user_id")}}
        if job is not None:
            yield from self._queued(document, job, now)
        if document is not None:
            self.state.update(tuple(document[f] for f in _FIELDS))

    def _queued(self, document: dict | None, job: Row, now: int) -> Iterator[Row]:
        if document is None:
            yield self._decision("unknown", doc_id=job.doc_id)
        elif document["lock_id"] is not None and document["lock_expires"] > now:
            yield self._decision("locked", document)
        elif document["status"] in ("Ready", "Blocked"):
            yield self._decision("settled", document)
        elif document["attempts"] >= self.options.max_attempts:
            self._unlock(document)
            document.update(status="Failed", lock_id=None, lock_expires=None)
            yield self._decision("exhausted", document, error_message=ATTEMPTS_EXCEEDED)
        else:
            self._unlock(document)
            expires = now + 60_000 * self.options.lock_minutes
            document.update(status="Processing", attempts=document["attempts"] + 1, lock_id=f"{now}-{document['doc_id']}", lock_expires=expires,
                            file_name=job.file_name or document["file_name"], user_id=document["user_id"] if job.user_id is None else job.user_id,
                            file_id=document["file_id"] if job.file_id is None else job.file_id)
            self.handle.registerTimer(expires)
            yield self._decision("claimed", document)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        document = dict(zip(_FIELDS, self.state.get(), strict=True)) if self.state.exists() else None
        if document and document["lock_id"] is not None and document["lock_expires"] <= expiredTimerInfo.getExpiryTimeInMs():
            document["lock_id"] = document["lock_expires"] = None
            self.state.update(tuple(document[f] for f in _FIELDS))
            yield self._decision("expired", document)

    def _unlock(self, document: dict) -> None:
        if document["lock_expires"] is not None:
            self.handle.deleteTimer(document["lock_expires"])

    @staticmethod
    def _decision(kind: str, document: dict | None = None, **more: Any) -> Row:
        from datetime import datetime, timezone

        row = {**dict.fromkeys(f.split()[0] for f in DECISION.split(", ")), **(document or {}), "kind": kind, **more}
        if isinstance(row["lock_expires"], int):
            row["lock_expires"] = datetime.fromtimestamp(row["lock_expires"] / 1000, timezone.utc)
        return Row(**{f.split()[0]: row[f.split()[0]] for f in DECISION.split(", ")})


def event(df: DataFrame, kind: str, **columns: Column | str) -> DataFrame:
    """Rows as events of one kind; what they don't say is null."""
    made = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    return df.select(*[F.lit(kind).alias("kind") if n == "kind" else made.get(n, F.lit(None)).cast(t).alias(n)
                       for n, t in (f.split() for f in EVENT.split(", "))])


def decisions(events: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The decisions of the keyed state on a stream of events."""
    lost = F.concat(F.lit("lost-"), F.pmod(F.xxhash64("value"), F.lit(_LOST_KEYS)).cast("string"))
    keyed = events.withColumn("key", F.coalesce(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), lost))
    return keyed.groupBy("key").transformWithState(Claims(options), DECISION, "Update", "ProcessingTime")

"""A log of running streams."""

from __future__ import annotations

import json
import logging

from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Writes start, progress and end of each streaming query to a logger, as JSON lines or as text."""

    def __init__(self, logger: logging.Logger | None = None, as_json: bool = True):
        self.logger, self.as_json = logger or logging.getLogger("newsloom.streams"), as_json

    def _say(self, level: int, event: str, **facts) -> None:
        facts = {"event": event, **facts}
        self.logger.log(level, json.dumps(facts, default=str) if self.as_json else " ".join(f"{k}={v}" for k, v in facts.items()))

    def onQueryStarted(self, event) -> None:
        self._say(logging.INFO, "started", id=event.id, run=event.runId, name=event.name, at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._say(logging.INFO, "progress", id=p.id, batch=p.batchId, rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, at=p.timestamp)

    def onQueryIdle(self, event) -> None:
        self._say(logging.DEBUG, "idle", id=event.id, at=event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self._say(logging.ERROR if event.exception else logging.INFO, "ended", id=event.id, error=event.exception)

"""When a repeated job is due: a small state file and a loop that outlives failures."""

from __future__ import annotations

import json
import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from skarn.sources.files import exists, read_text, replace_text

log = logging.getLogger(__name__)


@dataclass
class JobState:
    """The last run of a job, kept in ``path``; a missing or unreadable file means there was none."""

    spark: SparkSession
    path: str

    def read(self) -> dict:
        try:
            found = json.loads(read_text(self.spark, self.path)) if exists(self.spark, self.path) else {}
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def write(self, **values: object) -> None:
        replace_text(self.spark, self.path, json.dumps(self.read() | values))

    def last_run(self) -> datetime | None:
        try:
            at = datetime.fromisoformat(str(self.read().get("last_run")))
        except ValueError:
            return None
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)

    def seconds_until_due(self, interval: float, now: datetime | None = None) -> float:
        last = self.last_run()
        now = now or datetime.now(timezone.utc)
        return 0.0 if last is None else max(interval - (now - last).total_seconds(), 0.0)

    def is_due(self, interval: float, now: datetime | None = None) -> bool:
        return self.seconds_until_due(interval, now) == 0

    def next_run(self, interval: float) -> datetime | None:
        """With its zone; None if the job is due."""
        last = self.last_run()
        return last + timedelta(seconds=interval) if last else None


def run_forever(job: Callable[[], dict | None], state: JobState, interval: float, stop: threading.Event) -> int:
    """Run ``job`` whenever it is due until ``stop`` is set; a failure is logged and tried again after the interval. Returns how many runs there were."""
    runs = 0
    while not stop.wait(state.seconds_until_due(interval)):
        runs += 1
        try:
            result = job() or {}
        except Exception as error:
            log.exception("the job failed")
            result = {"error": str(error)}
        state.write(last_run=datetime.now(timezone.utc).isoformat(), **result)
    return runs

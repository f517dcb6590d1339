"""Progress messages, and comparing batches as they come in."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.diff import RegistryDiff, compare


def percent(done: int, total: int) -> float:
    return round(100.0 * done / total, 1) if total else 100.0


def event(kind: str, **values) -> str:
    """A server-sent event line."""
    return f"data: {json.dumps({'tipo': kind} | values, ensure_ascii=False)}\n\n"


class ProgressListener(StreamingQueryListener):
    """Hands each micro-batch's progress to ``send`` as an event line."""

    def __init__(self, send: Callable[[str], None]):
        self.send = send

    def onQueryStarted(self, event_):
        self.send(event("inicio", id=str(event_.id)))

    def onQueryProgress(self, event_):
        p = event_.progress
        self.send(event("progresso", lote=p.batchId, linhas=p.numInputRows))

    def onQueryIdle(self, event_):
        self.send(event("espera", id=str(event_.id)))

    def onQueryTerminated(self, event_):
        self.send(event("fim", erro=event_.exception))


def stream_diff(batches: DataFrame, registry: Callable[[], DataFrame], handle: Callable[[RegistryDiff, int], None], checkpoint: str):
    """Compares each micro-batch of a stream, as a partial load, with the registry of that time; returns the query."""

    def one(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            handle(compare(registry(), df, partial=True), number)

    return batches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

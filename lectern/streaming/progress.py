"""Progress of running streams, told to a function of the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """tell(name, status, rows) as a stream starts (`started`, 0), after each batch with rows (`progress`, rows so far) and
    at its end (`completed` or `failed`, rows so far). Register it with spark.streams.addListener; the calls
    come on a thread of the listener, in order."""

    def __init__(self, tell: Callable[[str, str, int], None]):
        self.tell, self.names, self.rows = tell, {}, {}

    def onQueryStarted(self, event) -> None:
        self.names[event.id], self.rows[event.id] = event.name or str(event.id), 0
        self.tell(self.names[event.id], "started", 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.rows[p.id] = self.rows.get(p.id, 0) + p.numInputRows
            self.tell(self.names.get(p.id, str(p.id)), "progress", self.rows[p.id])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(self.names.get(event.id, str(event.id)), "failed" if event.exception else "completed", self.rows.get(event.id, 0))

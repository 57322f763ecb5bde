"""What a stream has done so far, as messages."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Add it with spark.streams.addListener: messages grows by a line when a query starts, ends a batch with rows, or stops."""

    def __init__(self) -> None:
        self.messages: list[str] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.messages.append(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self.messages.append(f"batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.messages.append("failed" if event.exception else "done")

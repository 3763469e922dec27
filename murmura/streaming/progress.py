"""Progress of an ingesting stream, told batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls tell(message, documents so far) when the stream starts, after every batch and in the end."""

    def __init__(self, tell: Callable[[str, int], None]) -> None:
        self.tell, self.documents = tell, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell("started", self.documents)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.documents += event.progress.numInputRows
        self.tell(f"batch {event.progress.batchId}", self.documents)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell("failed" if event.exception else "done", self.documents)

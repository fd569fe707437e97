"""Progress of an analysis as a stream of updates, and a table's profile kept current from a stream of rows."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from quarrylens.model import DatasetReport, ProgressUpdate


def updates(run: Callable[[Callable[[ProgressUpdate], None]], DatasetReport]) -> Iterator[ProgressUpdate | DatasetReport]:
    """Run an analysis in a thread; yields its updates as they come and the report last. Its error is raised here."""
    pending: queue.Queue = queue.Queue()

    def work() -> None:
        try:
            pending.put(run(pending.put))
        except BaseException as error:  # handed to the reader
            pending.put(error)

    threading.Thread(target=work, daemon=True).start()
    while True:
        item = pending.get()
        if isinstance(item, BaseException):
            raise item
        yield item
        if isinstance(item, DatasetReport):
            return


def on_each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """Apply an analyzer's plan to every micro-batch of a stream and hand its small result to ``sink``."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink(plan(batch), epoch))

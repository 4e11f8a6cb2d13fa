"""The repeated run: one run per micro-batch of new page files."""

import logging
import threading

from pyspark.sql.streaming import StreamingQueryListener

from ..plans.run import RunOptions, run_once
from ..sources.pages import stream_pages
from .dead_letters import replay_dead_letters, write_dead_letter

logger = logging.getLogger(__name__)

# Gates of the queries that run, by run id.
_gates = {}


class StreamStopped(RuntimeError):
    """A batch was due after the query had been asked to stop."""


class BatchGate(StreamingQueryListener):
    """Lets a query end between two batches.

    Batches pass the gate when they start.  The listener hears of a batch when it has
    been committed to the checkpoint; until then stopping the query would throw it away.
    """

    def __init__(self, spark):
        self.run_id = None
        self._spark = spark
        self._changed = threading.Condition()
        self._started = -1
        # Last batch committed by run, and runs that ended; events may come before run_id is known.
        self._committed, self._over = {}, set()
        self._closed = False

    def enter(self, batch_id):
        with self._changed:
            if self._closed:
                # A batch starts only once the one before it is committed.
                self._committed[self.run_id] = self._started
                self._changed.notify_all()
                raise StreamStopped(f"batch {batch_id} is left for the next start")
            self._started = batch_id

    def close(self, timeout=None):
        """Admit no more batches; waits for the running one to be committed."""
        with self._changed:
            self._closed = True
            return self._changed.wait_for(
                lambda: self.run_id in self._over
                or self._committed.get(self.run_id, -1) >= self._started,
                timeout,
            )

    def forget(self):
        if _gates.pop(self.run_id, None) is not None:
            self._spark.streams.removeListener(self)

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        with self._changed:
            self._committed[str(event.progress.runId)] = event.progress.batchId
            self._changed.notify_all()

    def onQueryTerminated(self, event):
        with self._changed:
            self._over.add(str(event.runId))
            self._changed.notify_all()
        if str(event.runId) == self.run_id:
            self.forget()


def query_id(spark, checkpoint_path):
    """Id of the query, the same at every start from the checkpoint."""
    return spark.read.json(f"{checkpoint_path}/metadata").first()["id"]


def run_stream(
    spark,
    pages_path,
    client_factory,
    sink,
    checkpoint_path,
    interval=None,
    max_files=None,
    options=RunOptions(),
    quarantine_sink=None,
    on_batch_error="raise",
    dead_letter_path=None,
    max_bytes=None,
    replay=False,
    progress=None,
):
    """Start the repeated run over the files in ``pages_path``.

    With an ``interval`` ("30 minutes") it goes on until stopped; without one it
    works through the files that are there and ends.  ``max_files`` or ``max_bytes``
    bound a batch (see ``stream_pages``).

    A batch that fails stops the query, and the checkpoint replays it at the
    next start (``on_batch_error="raise"``); or its pages are written to
    ``dead_letter_path`` and the query goes on (``"dead_letter"``).  It is never
    just skipped: Spark would count a swallowed error as done.  With ``replay`` each
    batch that goes well is followed by another try of those that wait there.

    A batch writes to its own folder, named by the query's id and its number, and
    replaces what an earlier attempt left there: a replay doubles nothing, and
    other streams and runs can share the sink.  The id lives in the checkpoint.
    ``progress`` is a ``ProgressTable`` that gets a row per batch.
    """
    if on_batch_error not in ("raise", "dead_letter"):
        raise ValueError(f"unknown on_batch_error: {on_batch_error!r}")
    if on_batch_error == "dead_letter" and not dead_letter_path:
        raise ValueError("dead letters need a dead_letter_path")
    if replay and not dead_letter_path:
        raise ValueError("a replay needs a dead_letter_path")
    gate, ids = BatchGate(spark), []

    def record(run_id, batch_id, outcome, counts):
        if progress is not None:
            progress.record(spark, run_id, batch_id, outcome, counts, sink)

    def run_batch(pages, batch_id):
        gate.enter(batch_id)
        if not ids:
            ids.append(query_id(spark, checkpoint_path))
        run_id = ids[0]
        try:
            counts = run_once(
                pages, client_factory, sink, options, quarantine_sink, batch_id, run_id
            )
        except Exception:
            if on_batch_error == "raise":
                raise
            logger.exception("batch %s failed; its pages go to the dead letters", batch_id)
            write_dead_letter(pages, dead_letter_path, run_id, batch_id)
            record(run_id, batch_id, "dead_letter", {})
            return
        logger.info("batch %s: %s", batch_id, counts)
        record(run_id, batch_id, "stored", counts)
        if replay:
            replay_dead_letters(
                spark, dead_letter_path, client_factory, sink, options, quarantine_sink, run_id, progress
            )

    pages = stream_pages(spark, pages_path, max_files, max_bytes)
    writer = pages.writeStream.foreachBatch(run_batch)
    writer = writer.option("checkpointLocation", checkpoint_path)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    spark.streams.addListener(gate)
    try:
        query = writer.trigger(**trigger).start()
    except BaseException:
        spark.streams.removeListener(gate)
        raise
    gate.run_id = str(query.runId)
    _gates[gate.run_id] = gate
    if not query.isActive:
        gate.forget()
    return query


def stop_after_batch(query, timeout=None):
    """End the query once the running batch is committed; no further batch starts.

    After ``timeout`` seconds the batch is given up; the next start replays it, and what
    it wrote is replaced.  Returns whether the query ended between two batches.
    """
    gate = _gates.get(str(query.runId))
    between = gate.close(timeout) if gate is not None and query.isActive else not query.isActive
    query.stop()
    if gate is not None:
        gate.forget()
    return between


def run_until_stopped(query, timeout=None, grace=None):
    """Wait for the query; an interrupt or the timeout (seconds) ends it between two batches.

    ``grace`` bounds the wait for the running batch.  Returns True if it ended by itself.
    """
    ended = False
    try:
        ended = query.awaitTermination(timeout) if timeout else query.awaitTermination() or True
    except KeyboardInterrupt:
        pass
    finally:
        stop_after_batch(query, grace)
    return bool(ended)

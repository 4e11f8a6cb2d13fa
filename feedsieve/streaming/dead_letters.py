"""Pages of failed batches: kept with a marker, replayed as a source.

Each failed batch has a folder ``run=<id>/batch_id=<n>``.  ``_READY`` in it says that all
its pages are there, ``_REPLAYED`` that their posts are stored.  A replay writes to the
folder of the batch it makes good, so it can be repeated at any point without doubling.
"""

import logging
from dataclasses import dataclass

from ..plans.run import RunOptions, run_once
from ..session import child_folders, file_system, path_exists
from ..sources.pages import read_pages
from ..sources.post_tables import BATCH_COLUMN, RUN_COLUMN, batch_path

logger = logging.getLogger(__name__)

READY, REPLAYED = "_READY", "_REPLAYED"


@dataclass(frozen=True)
class DeadLetter:
    """A failed batch whose pages wait for a replay."""

    run_id: str
    batch_id: int
    path: str


def _mark(spark, path, marker):
    files, hadoop_path = file_system(spark, f"{path}/{marker}")
    files.create(hadoop_path, True).close()


def write_dead_letter(pages, path, run_id, batch_id):
    """Keep the pages of a failed batch, in place of what an earlier attempt left."""
    folder = batch_path(path, run_id, batch_id)
    pages.write.mode("overwrite").parquet(folder)
    _mark(pages.sparkSession, folder, READY)


def pending_dead_letters(spark, path, run_id=None):
    """Batches that have not been replayed, oldest number first; of one run if given."""
    found = []
    for run in child_folders(spark, path, RUN_COLUMN):
        if run_id not in (None, run):
            continue
        for number in child_folders(spark, f"{path}/{RUN_COLUMN}={run}", BATCH_COLUMN):
            folder = batch_path(path, run, number)
            if path_exists(spark, f"{folder}/{READY}") and not path_exists(spark, f"{folder}/{REPLAYED}"):
                found.append(DeadLetter(run, int(number), folder))
    return sorted(found, key=lambda d: (d.run_id, d.batch_id))


def replay_dead_letters(
    spark,
    path,
    client_factory,
    sink,
    options=RunOptions(),
    quarantine_sink=None,
    run_id=None,
    progress=None,
):
    """Run the waiting batches again; returns those that are stored now.

    Each is a run of its own over its pages; one that fails again is logged and goes on
    waiting.  ``options`` and sinks are those of the stream that left them.
    """
    stored = []
    for letter in pending_dead_letters(spark, path, run_id):
        try:
            counts = run_once(
                read_pages(spark, letter.path), client_factory, sink, options, quarantine_sink,
                letter.batch_id, letter.run_id,
            )
            if progress is not None:
                progress.record(spark, letter.run_id, letter.batch_id, "replayed", counts, sink)
            _mark(spark, letter.path, REPLAYED)
        except Exception:
            logger.exception("batch %s failed again; its pages go on waiting", letter.batch_id)
            continue
        logger.info("batch %s replayed: %s", letter.batch_id, counts)
        stored.append(letter)
    return stored

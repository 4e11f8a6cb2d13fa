"""One run: pages to labelled posts in a sink."""

from dataclasses import dataclass

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.replies import HIRING_POST
from ..operators.classify import classify_labels, split_quarantine
from ..operators.extract import extract_post_details, find_posts
from ..operators.html_posts import SelectorSpec
from ..operators.posts import (
    filter_relevant,
    first_per_url,
    limit_pages,
    limit_posts,
    search_posts,
)
from ..schema import labelled_post
from ..session import drop_shared, write_shared
from ..sources.answers import AnswerTable


@dataclass(frozen=True)
class RunOptions:
    """What a run reads from the pages and how it labels the posts.

    The limits and filters are off by default: a plain run labels every post it
    finds.  ``labels`` are pairs of a column and what is asked about it; all are asked
    for in one pass.  ``answers_path`` names a table of answers that outlives the run:
    a text is asked for once, also when a failed run is started again.
    ``exact_counts`` writes the extracted posts once, so that each stage is counted where
    Spark counts a task once, however often it runs.
    """

    selectors: SelectorSpec = SelectorSpec()
    max_pages: int | None = None
    search_text: str | None = None
    max_posts: int | None = None
    only_relevant: bool = False
    on_error: str = "fail"
    partitions: int | None = None
    reuse_answers: bool = False
    labels: tuple = (("content", HIRING_POST),)
    in_flight: int = 1
    answers_path: str | None = None
    exact_counts: bool = False

    def schema(self):
        """Columns of the posts that a run with these labels stores."""
        return labelled_post(*(spec.name for _, spec in self.labels))


class StageCounts:
    """Rows that passed each stage, counted while the run itself executes.

    Rows in front of a shuffle are counted again where their stage is run again after an
    executor is lost, unless the run is asked for ``exact_counts``.
    """

    def __init__(self):
        self._observations = {}

    def watch(self, stage, df):
        self._observations[stage] = observation = Observation(stage)
        return df.observe(observation, F.count(F.lit(1)).alias("rows"))

    def get(self):
        """Counts by stage; waits for the run to have written its result.

        A stage that the plan dropped because no rows reach it counts 0.
        """
        return {stage: seen.get.get("rows", 0) for stage, seen in self._observations.items()}


def _unwatched(stage, df):
    return df


def plan_posts(pages, options=RunOptions(), watch=_unwatched, scratch=None):
    """Posts of the pages, first per url, with the filters the options ask for.

    Everything that drops rows comes before the model is asked.  Tables written on the
    way are added to the list ``scratch``; without one none is written.
    """
    if options.max_pages is not None:
        pages = limit_pages(pages, options.max_pages)
    raw_posts = watch("found", find_posts(pages, options.selectors))
    posts = watch("extracted", extract_post_details(raw_posts))
    if options.exact_counts and scratch is not None:
        posts = write_shared(posts, "extracted")
        scratch.append(posts)
    if options.search_text:
        posts = search_posts(posts, options.search_text)
    posts = first_per_url(posts)
    if options.only_relevant:
        posts = filter_relevant(posts)
    return watch("scraped", limit_posts(posts, options.max_posts))


def run_once(
    pages,
    client_factory,
    sink,
    options=RunOptions(),
    quarantine_sink=None,
    batch_id=None,
    run_id=None,
):
    """Extract, label and store the posts of ``pages``; returns the stage counts.

    Under ``on_error="quarantine"`` the labelled rows are written once before
    they are split over the two sinks, so no row is asked for twice and none
    can land in both.  With a ``batch_id`` a repeated run replaces what that batch
    of ``run_id`` wrote before; without one it appends.
    """
    if options.on_error == "quarantine" and quarantine_sink is None:
        raise ValueError("a quarantining run needs a quarantine_sink")
    counts, scratch = StageCounts(), []
    try:
        posts = plan_posts(pages, options, counts.watch, scratch).drop("page_id", "pos")
        labelled = classify_labels(
            posts,
            options.labels,
            client_factory,
            on_error=options.on_error,
            partitions=options.partitions,
            in_flight=options.in_flight,
            reuse_answers=options.reuse_answers,
            answers=AnswerTable(options.answers_path) if options.answers_path else None,
            scratch=scratch,
        )
        labelled = counts.watch("classified", labelled)
        if options.on_error == "fail":
            sink.write(counts.watch("appended", labelled), batch_id, run_id)
        else:
            answered = write_shared(labelled, "labelled")
            scratch.append(answered)
            good, failed = split_quarantine(answered)
            sink.write(counts.watch("appended", good), batch_id, run_id)
            quarantine_sink.write(failed, batch_id, run_id)
        return counts.get()
    finally:
        for table in scratch:
            drop_shared(table)

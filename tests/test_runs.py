"""Single and repeated runs."""

import glob
import os
import sys
import time
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql.types import StringType, StructField, StructType

from feedsieve.functions.clients import ByPromptClient, RuleClient, TermsClient
from feedsieve.functions.fixed_values import POST_BASE_URL
from feedsieve.functions.replies import HIRING_POST, LabelSpec
from feedsieve.operators.classify import ERROR
from feedsieve.plans import fixtures
from feedsieve.plans.run import RunOptions, plan_posts, run_once
from feedsieve.schema import LABELLED_POST, PAGE
from feedsieve.session import path_exists, shared_dir
from feedsieve.sources.pages import read_pages
from feedsieve.sources.post_tables import PostSink, batch_path
from feedsieve.sources.answers import AnswerTable
from feedsieve.streaming import repeated_run
from feedsieve.streaming.dead_letters import pending_dead_letters, replay_dead_letters
from feedsieve.streaming.progress import ProgressTable
from feedsieve.streaming.repeated_run import query_id, run_stream, run_until_stopped, stop_after_batch


# The client below is sent to the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def page(page_id, *posts):
    body = "".join(
        f'<div class="feed-shared-update-v2" data-urn="{urn}">'
        f'<span class="update-components-actor__title">Jane</span>'
        f'<span class="break-words">{content}</span></div>'
        for urn, content in posts
    )
    return page_id, None, f"<html>{body}</html>"


PAGES = [
    page(0, ("u:1", "Hiring, send your CV"), ("u:2", "hello"), ("u:1", "later copy")),
    page(1, ("u:3", "BAD reply"), ("u:4", "a job, email your resume")),
    page(2, ("u:2", "copy in another batch"), ("u:5", "world")),
]


@dataclass(frozen=True)
class MoodyClient:
    """The rule, but no JSON where the text says BAD, while ``marker`` exists."""

    marker: str = ""

    def __call__(self):
        answer = RuleClient()()

        def moody(requests, schema):
            bad = not self.marker or os.path.exists(self.marker)
            return [
                "sorry" if bad and "BAD" in request[-1]["content"] else reply
                for request, reply in zip(requests, answer(requests, schema))
            ]

        return moody


def labels(df):
    return sorted((r.url.removeprefix(POST_BASE_URL), r.hiring_post) for r in df.collect())


@pytest.fixture
def arriving(spark, tmp_path):
    """One file per page, in order."""
    path = str(tmp_path / "arriving")
    for row in PAGES:
        spark.createDataFrame([row], PAGE).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_run_once(spark, tmp_path, format):
    sink = PostSink(str(tmp_path / "out"), format)
    counts = run_once(spark.createDataFrame(PAGES, PAGE), RuleClient(), sink)
    assert counts == {"found": 7, "extracted": 7, "scraped": 5, "classified": 5, "appended": 5}
    assert labels(sink.read(spark)) == [("u:1", 1), ("u:2", 0), ("u:3", 0), ("u:4", 1), ("u:5", 0)]
    run_once(spark.createDataFrame(PAGES, PAGE), RuleClient(), sink)
    assert sink.total(spark) == 10


def test_run_of_no_posts(spark, tmp_path):
    sink = PostSink(str(tmp_path / "out"))
    counts = run_once(spark.createDataFrame([page(0)], PAGE), RuleClient(), sink)
    assert set(counts) == {"found", "extracted", "scraped", "classified", "appended"}
    assert set(counts.values()) == {0}
    assert sink.read(spark).count() == 0


def test_options(spark):
    pages = spark.createDataFrame(PAGES, PAGE)

    def urls(**options):
        return sorted(r.url.removeprefix(POST_BASE_URL) for r in plan_posts(pages, RunOptions(**options)).collect())

    assert urls(only_relevant=True) == ["u:1", "u:4"]
    assert urls(search_text="your") == ["u:1", "u:4"]
    assert urls(search_text="copy") == ["u:1", "u:2"]
    assert urls(max_posts=2) == ["u:1", "u:2"]
    assert urls(max_pages=2) == ["u:1", "u:2", "u:3", "u:4"]


def test_failed_run_writes_nothing(spark, tmp_path):
    sink = PostSink(str(tmp_path / "out"))
    pages = spark.createDataFrame(PAGES, PAGE)
    with pytest.raises(Exception):
        run_once(pages, MoodyClient(), sink)
    assert not path_exists(spark, sink.path) or sink.read(spark).count() == 0
    with pytest.raises(ValueError):
        run_once(pages, MoodyClient(), sink, RunOptions(on_error="quarantine"))


def test_quarantine_run(spark, tmp_path):
    sink, rest = PostSink(str(tmp_path / "out")), PostSink(str(tmp_path / "rest"))
    options = RunOptions(on_error="quarantine", reuse_answers=True, partitions=2)
    counts = run_once(spark.createDataFrame(PAGES, PAGE), MoodyClient(), sink, options, rest)
    assert (counts["scraped"], counts["classified"], counts["appended"]) == (5, 5, 4)
    assert labels(sink.read(spark)) == [("u:1", 1), ("u:2", 0), ("u:4", 1), ("u:5", 0)]
    with_error = StructType([*LABELLED_POST.fields, StructField(ERROR, StringType())])
    (failed,) = rest.read(spark, with_error).collect()
    assert (failed.content, failed.hiring_post, failed.error) == ("BAD reply", None, "bad_json")
    assert not glob.glob(f"{shared_dir(spark)}/feedsieve/labelled-*")


def stream(spark, arriving, tmp_path, client, **options):
    sink = PostSink(str(tmp_path / "out"))
    query = run_stream(
        spark, arriving, client, sink, str(tmp_path / "state"), max_files=1, **options
    )
    return sink, query


def test_stream_is_a_run_per_batch(spark, arriving, tmp_path):
    """The first post per url is kept within a batch, not across batches."""
    sink, query = stream(spark, arriving, tmp_path, RuleClient())
    assert run_until_stopped(query) is True
    got = labels(sink.read(spark))
    assert got == [("u:1", 1), ("u:2", 0), ("u:2", 0), ("u:3", 0), ("u:4", 1), ("u:5", 0)]
    sink, query = stream(spark, arriving, tmp_path, RuleClient())
    assert run_until_stopped(query) is True
    assert labels(sink.read(spark)) == got


def test_stream_equals_runs_over_the_same_files(spark, sf_dir, tmp_path):
    arriving = str(tmp_path / "pages")
    fixtures.pages(spark, sf_dir).repartitionByRange(3, "page_id").write.parquet(arriving)
    sink, query = stream(spark, arriving, tmp_path, RuleClient())
    query.awaitTermination()
    single = PostSink(str(tmp_path / "single"))
    run_once(read_pages(spark, arriving), RuleClient(), single)
    assert sorted(map(tuple, sink.read(spark).collect())) == sorted(
        map(tuple, single.read(spark).collect())
    )


def test_failed_batch_is_replayed(spark, arriving, tmp_path):
    marker = tmp_path / "model_is_down"
    marker.touch()
    client = MoodyClient(str(marker))
    sink, query = stream(spark, arriving, tmp_path, client)
    with pytest.raises(StreamingQueryException):
        run_until_stopped(query)
    assert labels(sink.read(spark)) == [("u:1", 1), ("u:2", 0)]
    marker.rename(tmp_path / "model_is_up")
    sink, query = stream(spark, arriving, tmp_path, client)
    assert run_until_stopped(query) is True
    assert labels(sink.read(spark)) == [
        ("u:1", 1), ("u:2", 0), ("u:2", 0), ("u:3", 0), ("u:4", 1), ("u:5", 0),
    ]


def test_dead_letters_keep_the_pages(spark, arriving, tmp_path):
    dead = str(tmp_path / "dead")
    sink, query = stream(
        spark, arriving, tmp_path, MoodyClient(), on_batch_error="dead_letter", dead_letter_path=dead
    )
    assert run_until_stopped(query) is True
    assert labels(sink.read(spark)) == [("u:1", 1), ("u:2", 0), ("u:2", 0), ("u:5", 0)]
    assert [r.page_id for r in spark.read.parquet(dead).collect()] == [1]
    run = query_id(spark, str(tmp_path / "state"))
    pages = read_pages(spark, batch_path(dead, run, 1))
    run_once(pages, RuleClient(), sink, batch_id=1, run_id=run)
    assert len(labels(sink.read(spark))) == 6


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_runs_and_streams_share_a_sink(spark, arriving, tmp_path, format):
    sink = PostSink(str(tmp_path / "out"), format)
    run_once(read_pages(spark, arriving), RuleClient(), sink)
    for state in ("a", "b", "b"):
        checkpoint = str(tmp_path / state)
        run_stream(spark, arriving, RuleClient(), sink, checkpoint, max_files=1).awaitTermination()
    # The run keeps the first post per url over all pages, each stream per batch.
    assert len(labels(sink.read(spark))) == 5 + 6 + 6


def test_stop(spark, arriving, tmp_path):
    sink, query = stream(spark, arriving, tmp_path, RuleClient(), interval="1 second")
    query.processAllAvailable()
    assert run_until_stopped(query, timeout=1) is False
    assert not query.isActive
    assert sink.read(spark).count() == 6


ALL = [("u:1", 1), ("u:2", 0), ("u:2", 0), ("u:3", 0), ("u:4", 1), ("u:5", 0)]


@dataclass(frozen=True)
class SlowRule:
    seconds: float = 2.0

    def __call__(self):
        answer = RuleClient()()

        def slow(requests, schema):
            time.sleep(self.seconds)
            return answer(requests, schema)

        return slow


def test_stop_after_the_running_batch(spark, arriving, tmp_path):
    """What runs is finished and committed, nothing starts behind it, nothing is lost."""
    checkpoint, sink = str(tmp_path / "state"), PostSink(str(tmp_path / "out"))
    query = run_stream(spark, arriving, SlowRule(), sink, checkpoint, interval="1 second", max_files=1)
    while repeated_run._gates[str(query.runId)]._started < 0:
        time.sleep(0.05)
    assert stop_after_batch(query)
    assert not query.isActive and not repeated_run._gates
    done = {int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit()}
    stored = {r.batch_id for r in sink.read(spark, batches=True).collect()}
    assert done == stored and len(done) < 3
    before = {r.url for r in sink.read(spark).collect()}
    query = run_stream(spark, arriving, RuleClient(), sink, checkpoint, max_files=1)
    assert run_until_stopped(query) is True
    assert labels(sink.read(spark)) == ALL and before <= {r.url for r in sink.read(spark).collect()}


def test_batch_given_up_is_replayed(spark, arriving, tmp_path):
    checkpoint, sink = str(tmp_path / "state"), PostSink(str(tmp_path / "out"))
    query = run_stream(spark, arriving, SlowRule(30), sink, checkpoint, max_files=1)
    while repeated_run._gates[str(query.runId)]._started < 0:
        time.sleep(0.05)
    assert run_until_stopped(query, timeout=1, grace=0.1) is False
    assert run_until_stopped(run_stream(spark, arriving, RuleClient(), sink, checkpoint, max_files=1))
    assert labels(sink.read(spark)) == ALL


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_dead_letters_are_replayed_once(spark, arriving, tmp_path, format):
    dead, marker = str(tmp_path / "dead"), tmp_path / "model_is_down"
    marker.touch()
    client, progress = MoodyClient(str(marker)), ProgressTable(str(tmp_path / "progress"))
    sink = PostSink(str(tmp_path / "out"), format)
    options = dict(on_batch_error="dead_letter", dead_letter_path=dead, progress=progress)
    run_stream(spark, arriving, client, sink, str(tmp_path / "state"), max_files=1, **options).awaitTermination()

    def rows():
        found = progress.read(spark).select("batch_id", "outcome", "found", "scraped", "stored")
        return sorted(map(tuple, found.collect()))

    assert [d.batch_id for d in pending_dead_letters(spark, dead)] == [1]
    assert rows() == [(0, "stored", 3, 2, 2), (1, "dead_letter", None, None, 0), (2, "stored", 2, 2, 2)]
    assert replay_dead_letters(spark, dead, client, sink) == []
    assert len(pending_dead_letters(spark, dead)) == 1
    marker.rename(tmp_path / "model_is_up")
    for _ in range(2):
        replay_dead_letters(spark, dead, client, sink, progress=progress)
        assert labels(sink.read(spark)) == ALL
        assert pending_dead_letters(spark, dead) == []
    assert rows()[1] == (1, "replayed", 2, 2, 2)
    numbers = sink.read(spark, batches=True).select("url", "batch_id").collect()
    assert sorted(r.batch_id for r in numbers) == [0, 0, 1, 1, 2, 2]


def test_the_next_batch_replays(spark, arriving, tmp_path):
    """As a failed iteration's posts come back with the next refresh."""
    sink, dead = PostSink(str(tmp_path / "out")), str(tmp_path / "dead")

    def fail_once(*args, **options):
        if args[5] == 1 and not seen:
            seen.append(args[5])
            raise OSError("down")
        return once(*args, **options)

    seen, once = [], repeated_run.run_once
    repeated_run.run_once = fail_once
    try:
        run_stream(
            spark, arriving, RuleClient(), sink, str(tmp_path / "state"), max_files=1,
            on_batch_error="dead_letter", dead_letter_path=dead, replay=True,
        ).awaitTermination()
    finally:
        repeated_run.run_once = once
    assert seen == [1] and labels(sink.read(spark)) == ALL
    assert pending_dead_letters(spark, dead) == []


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    path = str(tmp_path / "backlog")
    for n in range(10):
        spark.createDataFrame([page(n, (f"u:{n}", "text"))], PAGE).coalesce(1).write.mode("append").parquet(path)
    largest = max(os.path.getsize(f) for f in glob.glob(f"{path}/*.parquet"))
    sink = PostSink(str(tmp_path / "out"))
    state = str(tmp_path / "state")
    run_stream(spark, path, RuleClient(), sink, state, max_bytes=3 * largest).awaitTermination()
    rows = sink.read(spark, batches=True).collect()
    assert len({r.url for r in rows}) == len(rows) == 10
    assert len({r.batch_id for r in rows}) > 1
    with pytest.raises(ValueError):
        run_stream(spark, path, RuleClient(), sink, state, max_files=1, max_bytes=1)


def test_run_with_two_labels_and_kept_answers(spark, tmp_path):
    other = LabelSpec("names_jane", "Answer 1 if the text names Jane.")
    client = ByPromptClient(((HIRING_POST.prompt, RuleClient()), (other.prompt, TermsClient(("jane",)))))
    options = RunOptions(
        labels=(("content", HIRING_POST), ("profile_name", other)), in_flight=3, exact_counts=True,
        answers_path=str(tmp_path / "answers"),
    )
    sink, pages = PostSink(str(tmp_path / "out")), spark.createDataFrame(PAGES, PAGE)
    before = set(glob.glob(f"{shared_dir(spark)}/feedsieve/*"))
    for runs in (1, 2):
        counts = run_once(pages, client, sink, options)
        assert counts == {"found": 7, "extracted": 7, "scraped": 5, "classified": 5, "appended": 5}
        rows = sink.read(spark, options.schema()).collect()
        assert len(rows) == 5 * runs and all(r.names_jane == 1 for r in rows)
        assert sum(r.hiring_post for r in rows) == 2 * runs
        # Five contents and one name.
        assert AnswerTable(options.answers_path).known(spark).count() == 6
    assert set(glob.glob(f"{shared_dir(spark)}/feedsieve/*")) == before


def test_stream_arguments(spark):
    for options in (
        {"on_batch_error": "skip"},
        {"on_batch_error": "dead_letter"},
        {"replay": True},
    ):
        with pytest.raises(ValueError):
            run_stream(spark, "p", RuleClient(), PostSink("s"), "c", **options)

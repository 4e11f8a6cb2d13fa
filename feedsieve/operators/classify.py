"""Labelling text columns with a language model.

A label is a pair ``(input column, LabelSpec)``; several labels are asked for in one map
over the rows.
"""

from collections import deque
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import islice
from operator import or_

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.replies import (
    CLIENT_ERROR,
    EMPTY_INPUT,
    HIRING_POST,
    NO_ANSWER,
    read_reply,
    request_messages,
)
from ..session import drop_shared, new_table_path, write_shared
from ..sources.answers import AnswerTable

ERROR = "error"


class LabelError(RuntimeError):
    """A row could not be labelled."""


def _checked(df, labels, on_error):
    labels = [(column, spec) for column, spec in labels]
    if on_error not in ("fail", "quarantine"):
        raise ValueError(f"unknown on_error: {on_error!r}")
    names = [spec.name for _, spec in labels]
    if not names or len(set(names)) < len(names):
        raise ValueError("a run needs labels of different names")
    taken = {*names, ERROR} if on_error == "quarantine" else set(names)
    if taken & set(df.columns):
        raise ValueError("a label or error column is there already")
    return labels


def infer_labels(
    df, labels, client_factory, on_error="fail", batch_size=1, partitions=None, in_flight=1
):
    """Add a column for each label from the model's answers.

    ``on_error="fail"`` gives up at the first row without a valid answer, and with it
    the whole job.  ``"quarantine"`` leaves the label null and adds a column ``error``
    with the reason, behind the label's name if there are several labels.

    The client is built once per task and gets ``batch_size`` requests per call.  A call
    that fails counts for its own requests alone; of several requests in one call each
    is then asked again by itself, unless the client returns the exception in the place
    of the reply.  ``in_flight`` calls of a task run at a time, in threads that share the
    client; answers keep the order of the rows, and no further call starts until the
    oldest is answered.  ``partitions`` sets the number of tasks.

    A retried task asks again, so write the result before using it twice, or ask through
    an answer table (``classify_labels``).  Put filters in front: they are not pushed
    through this step.
    """
    labels = _checked(df, labels, on_error)
    quarantine = on_error == "quarantine"
    fields = [T.StructField(spec.name, T.LongType()) for _, spec in labels]
    schema = T.StructType([*df.schema.fields, *fields])
    if quarantine:
        schema = schema.add(ERROR, T.StringType())
    if partitions is not None:
        # Round robin, so copies of a row do not end up in one task.
        df = df.repartition(partitions)

    def run(batches):
        specs = [spec for _, spec in labels]
        with _Asker(client_factory(), specs, batch_size, in_flight, quarantine) as asker:
            for batch in batches:
                columns = [batch.column(column).to_pylist() for column, _ in labels]
                asked = [(spec, text) for row in zip(*columns) for spec, text in zip(specs, row)]
                answers = list(asker.answers(asked))
                added, reasons = [], [[] for _ in range(batch.num_rows)]
                for n, spec in enumerate(specs):
                    own = answers[n :: len(specs)]
                    added.append(pa.array([label for label, _ in own], pa.int64()))
                    for reason, (_, error) in zip(reasons, own):
                        if error:
                            reason.append(f"{spec.name}: {error}" if len(specs) > 1 else error)
                names = [*batch.schema.names, *(spec.name for spec in specs)]
                if quarantine:
                    added.append(pa.array(["; ".join(r) or None for r in reasons], pa.string()))
                    names.append(ERROR)
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return df.mapInArrow(run, schema)


def infer(df, input_col, spec, client_factory, on_error="fail", batch_size=1, **options):
    """``infer_labels`` for one label."""
    return infer_labels(df, [(input_col, spec)], client_factory, on_error, batch_size, **options)


class _Asker:
    """Asks for ``(spec, text)`` pairs, a bounded number of calls at a time, in order."""

    def __init__(self, client, specs, batch_size, in_flight, quarantine):
        self._client, self._quarantine = client, quarantine
        self._batch_size, self._in_flight = batch_size, in_flight
        self._pool = ThreadPoolExecutor(in_flight) if in_flight > 1 else None
        self._schemas = {spec: spec.json_schema() for spec in specs}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self._pool is not None:
            self._pool.shutdown(wait=False, cancel_futures=True)

    def answers(self, asked):
        """``(label, error)`` of each pair; empty texts are not asked for."""
        found = self._found((spec, text) for spec, text in asked if text)
        for spec, text in asked:
            label, error = next(found) if text else (None, EMPTY_INPUT)
            if error and not self._quarantine:
                raise LabelError(f"{spec.name}: {error}")
            yield label, error

    def _found(self, asked):
        calls = _calls(asked, self._batch_size)
        if self._pool is None:
            for call in calls:
                yield from self._ask(*call)
            return
        waiting = deque(self._pool.submit(self._ask, *call) for call in islice(calls, self._in_flight))
        while waiting:
            yield from waiting.popleft().result()
            waiting.extend(self._pool.submit(self._ask, *call) for call in islice(calls, 1))

    def _ask(self, spec, texts):
        try:
            schema = self._schemas[spec]
            replies = self._client([request_messages(spec.prompt, text) for text in texts], schema)
            if len(replies) != len(texts):
                raise LabelError(f"{len(replies)} replies to {len(texts)} requests")
        except Exception as problem:
            if len(texts) == 1 or not self._quarantine:
                return [_read(problem)] * len(texts)
            return [answer for text in texts for answer in self._ask(spec, [text])]
        return [_read(reply) for reply in replies]


def _calls(asked, batch_size):
    """``(spec, texts)`` of each call; a call asks for one label."""
    spec, texts = None, []
    for this, text in asked:
        if texts and (this is not spec or len(texts) == batch_size):
            yield spec, texts
            texts = []
        spec = this
        texts.append(text)
    if texts:
        yield spec, texts


def _read(reply):
    if isinstance(reply, Exception):
        return None, f"{CLIENT_ERROR}: {reply}"
    return read_reply(reply)


# --- Asking once ----------------------------------------------------------------


def classify_labels(
    df,
    labels,
    client_factory,
    on_error="fail",
    batch_size=1,
    partitions=None,
    in_flight=1,
    reuse_answers=False,
    answers=None,
    scratch=None,
):
    """Add the labels; ``reuse_answers`` or ``answers`` ask once per prompt and text.

    ``answers`` is an ``AnswerTable`` that outlives the run: what it holds is not asked
    for, and what is answered is added to it as soon as a task ends, also where the run
    fails later on.  ``reuse_answers`` alone keeps a table for this call.  Failed requests
    are not kept, so the next run asks for them again.  Under ``on_error="fail"`` all
    that can be answered is stored before the error is raised.

    Both ways write ``df`` once to the shared folder and work on that table, so ``df`` is
    computed once.  Tables that may go once the result is stored are added to the list
    ``scratch``.  Answers come back by digest: the rows of a text that makes up a third
    of the table meet in one join partition, which the adaptive skew join splits.
    """
    labels = _checked(df, labels, on_error)
    options = dict(batch_size=batch_size, partitions=partitions, in_flight=in_flight)
    if not reuse_answers and answers is None:
        return infer_labels(df, labels, client_factory, on_error, **options)

    rows = write_shared(df, "unlabelled")
    if scratch is not None:
        scratch.append(rows)
    if answers is None:
        answers = AnswerTable(new_table_path(df.sparkSession, "answers"))
    answered = ask_once(rows, labels, client_factory, answers, **options)
    if scratch is not None:
        scratch.append(answered)
    if on_error == "fail":
        failed = _failed(rows, labels, answered)
        if failed:
            raise LabelError(failed)
    return _with_answers(rows, labels, answered, on_error)


def _key(spec, text):
    """Digest of the request; null for texts that are not asked for."""
    return F.when(text != "", F.sha2(F.concat(F.lit(spec.key() + ":"), text), 256))


def ask_once(rows, labels, client_factory, answers, **options):
    """Ask for what ``answers`` does not hold; returns ``(key, label, error)`` of the rows.

    The new requests are written before they are asked, so a retried task asks for
    those of its own partition only.  What is returned is written as well: a join with a
    plain table can be split where a text has very many rows.
    """
    spark = rows.sparkSession
    specs = [spec for _, spec in labels]
    requests = [
        F.struct(F.lit(n).alias("spec"), _key(spec, F.col(column)).alias("key"), F.col(column).alias("text"))
        for n, (column, spec) in enumerate(labels)
    ]
    every = rows.select(F.explode(F.array(*requests)).alias("r")).select("r.*").where("key is not null")
    wanted = every.dropDuplicates(["key"]).join(answers.known(spark), "key", "left_anti")
    wanted = write_shared(wanted, "requests")
    try:
        answers.add(_ask_rows(wanted, specs, client_factory, **options))
    finally:
        drop_shared(wanted)
    keys = every.select("key").distinct()
    return write_shared(answers.latest(spark).join(keys, "key", "left_semi"), "answered")


def _ask_rows(requests, specs, client_factory, batch_size, partitions, in_flight):
    if partitions is not None:
        requests = requests.repartition(partitions)

    def run(batches):
        with _Asker(client_factory(), specs, batch_size, in_flight, True) as asker:
            for batch in batches:
                numbers, texts = batch.column("spec").to_pylist(), batch.column("text").to_pylist()
                found = list(asker.answers([(specs[n], text) for n, text in zip(numbers, texts)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        pa.array([label for label, _ in found], pa.int64()),
                        pa.array([error for _, error in found], pa.string()),
                    ],
                    names=["key", "label", "error"],
                )

    return requests.mapInArrow(run, "key string, label long, error string")


def _joined(rows, labels, answered):
    """Rows with a struct ``(label, error)`` per label."""
    for n, (column, spec) in enumerate(labels):
        key = F.coalesce(_key(spec, F.col(column)), F.lit("")).alias("_digest")
        mine = answered.select(
            F.col("key").alias("_digest"), F.struct("label", "error").alias(f"_answer{n}")
        )
        rows = rows.select("*", key).join(mine, "_digest", "left").drop("_digest")
    return rows


def _reasons(labels):
    def reason(n, column, spec):
        answer = F.col(f"_answer{n}")
        error = F.when(F.coalesce(F.col(column) == "", F.lit(True)), F.lit(EMPTY_INPUT)).when(
            answer["label"].isNull(), F.coalesce(answer["error"], F.lit(NO_ANSWER))
        )
        return F.concat(F.lit(f"{spec.name}: "), error) if len(labels) > 1 else error

    each = [reason(n, column, spec) for n, (column, spec) in enumerate(labels)]
    return F.nullif(F.concat_ws("; ", *each), F.lit(""))


def _failed(rows, labels, answered):
    """Why some row has no answer, or None; errors that are left are those of this run."""
    empty = [F.coalesce(F.col(column) == "", F.lit(True)) for column, _ in labels]
    if rows.where(reduce(or_, empty)).limit(1).count():
        return EMPTY_INPUT
    refused = answered.where("label is null").limit(1).collect()
    return refused[0].error if refused else None


def _with_answers(rows, labels, answered, on_error):
    found = _joined(rows, labels, answered)
    added = [F.col(f"_answer{n}.label").alias(spec.name) for n, (_, spec) in enumerate(labels)]
    if on_error == "quarantine":
        added.append(_reasons(labels).alias(ERROR))
    return found.select(*rows.columns, *added)


def classify(df, input_col, spec, client_factory, on_error="fail", batch_size=1, **options):
    """``classify_labels`` for one label."""
    return classify_labels(df, [(input_col, spec)], client_factory, on_error, batch_size, **options)


def classify_jobs(posts, client_factory, spec=HIRING_POST, **options):
    """Label posts as hiring posts or not: adds ``hiring_post``."""
    return classify(posts, "content", spec, client_factory, **options)


def split_quarantine(labelled):
    """``(labelled rows, failed rows)`` of a quarantining run.

    Both parts read the same table: pass one that has been written, else the
    model is asked twice.
    """
    failed = F.col(ERROR).isNotNull()
    return labelled.where(~failed).drop(ERROR), labelled.where(failed)

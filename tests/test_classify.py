"""Labelling: answers, failures, quarantine, calls."""

import json
import os
import sys
import threading
import time
import uuid
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.errors import PythonException

from feedsieve.functions import clients, replies
from feedsieve.functions.clients import ChatClient, RuleClient, TermsClient
from feedsieve.functions.replies import LabelSpec
from feedsieve.operators import classify as classify_module
from feedsieve.operators.classify import (
    LabelError,
    classify,
    classify_jobs,
    classify_labels,
    infer,
    infer_labels,
    split_quarantine,
)
from feedsieve.session import drop_shared
from feedsieve.sources.answers import AnswerTable

# The client below is sent to the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPEC = LabelSpec("label", "Answer with the number in the text.")


@dataclass(frozen=True)
class ScriptedClient:
    """Replies with the text itself, fails on "boom"; notes each call."""

    log_dir: str | None = None

    def __call__(self):
        def answer(requests, schema):
            texts = [messages[-1]["content"] for messages in requests]
            if self.log_dir:
                with open(os.path.join(self.log_dir, uuid.uuid4().hex), "w") as out:
                    json.dump(texts, out)
            if "boom" in texts:
                raise OSError("no answer")
            if "short" in texts:
                return []
            return ['{"classification": ' + text + "}" for text in texts]

        return answer


def calls(log_dir):
    found = []
    for name in os.listdir(log_dir):
        with open(os.path.join(log_dir, name)) as source:
            found.append(json.load(source))
    return found


def table(spark, texts, partitions=2):
    return spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(partitions)


def labels(df):
    return {r.n: tuple(r[2:]) for r in df.collect()}


def test_labels(spark):
    df = infer(table(spark, ["1", "0", "-7", "true"]), "t", SPEC, ScriptedClient())
    assert df.schema.simpleString() == "struct<n:int,t:string,label:bigint>"
    assert labels(df) == {0: (1,), 1: (0,), 2: (-7,), 3: (1,)}


@pytest.mark.parametrize("bad", ["x", "", None, "1.5", "boom", "short"])
def test_fail_gives_up(spark, bad):
    with pytest.raises(PythonException):
        infer(table(spark, ["1", bad, "2"]), "t", SPEC, ScriptedClient()).collect()


@pytest.mark.parametrize("batch_size", [1, 3, 100])
def test_quarantine_keeps_the_rest(spark, batch_size):
    texts = ["1", "x", "", None, "boom", "5", "short", "1.5", "6"]
    df = infer(table(spark, texts, 1), "t", SPEC, ScriptedClient(), "quarantine", batch_size)
    got = labels(df)
    assert {n: label for n, (label, _) in got.items() if label is not None} == {0: 1, 5: 5, 8: 6}
    assert got[1][1] == replies.BAD_JSON
    assert got[2][1] == got[3][1] == replies.EMPTY_INPUT
    assert got[4][1] == f"{replies.CLIENT_ERROR}: no answer"
    assert got[6][1].startswith(replies.CLIENT_ERROR)
    assert got[7][1] == replies.NOT_AN_INTEGER
    good, failed = split_quarantine(df)
    assert (good.count(), failed.count()) == (3, 6)
    assert good.columns == ["n", "t", "label"]


def test_batches_and_partitions(spark, tmp_path):
    texts, client = [str(n) for n in range(100)], ScriptedClient(str(tmp_path))
    df = infer(table(spark, texts), "t", SPEC, client, batch_size=8, partitions=5)
    assert len(labels(df)) == 100
    sizes = [len(texts) for texts in calls(tmp_path)]
    assert sum(sizes) == 100 and max(sizes) == 8
    assert df.rdd.getNumPartitions() == 5


def test_reused_answers(spark, tmp_path):
    texts = [str(n % 7) if n % 3 else "42" for n in range(600)]
    client = ScriptedClient(str(tmp_path))
    df = classify(table(spark, texts, 4), "t", SPEC, client, reuse_answers=True)
    assert labels(df) == {n: (int(text),) for n, text in enumerate(texts)}
    assert sorted(t for texts in calls(tmp_path) for t in texts) == sorted({*map(str, range(7)), "42"})


def test_reused_answers_in_quarantine(spark):
    texts = ["1", None, "", "x", "x", None]
    df = classify(table(spark, texts), "t", SPEC, ScriptedClient(), "quarantine", reuse_answers=True)
    assert labels(df) == {
        0: (1, None),
        1: (None, replies.EMPTY_INPUT),
        2: (None, replies.EMPTY_INPUT),
        3: (None, replies.BAD_JSON),
        4: (None, replies.BAD_JSON),
        5: (None, replies.EMPTY_INPUT),
    }


def test_empty_input_keeps_the_schema(spark):
    df = classify_jobs(spark.createDataFrame([], "content string"), RuleClient())
    assert df.columns == ["content", "hiring_post"] and df.count() == 0


def test_arguments(spark):
    df = table(spark, ["1"])
    with pytest.raises(ValueError):
        infer(df, "t", SPEC, ScriptedClient(), on_error="skip")
    with pytest.raises(ValueError):
        infer(df.withColumnRenamed("n", "label"), "t", SPEC, ScriptedClient())


def test_terms_client():
    answer = TermsClient(("pune",))()
    requests = [replies.request_messages("p", text) for text in ("In PUNE", "in Rome")]
    assert answer(requests, {}) == ['{"classification": 1}', '{"classification": 0}']


def test_rule_client_with_regex_keywords():
    answer = RuleClient(keywords=(r"hir\w+",))()
    requests = [replies.request_messages("p", t) for t in ("HIRING: send CV", "Job: send CV")]
    assert answer(requests, {}) == ['{"classification": 1}', '{"classification": 0}']


def test_chat_client_request(monkeypatch):
    """The request as it would be sent; nothing is opened."""
    sent = []

    class Response:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self, *_):
            return json.dumps({"message": {"content": '{"classification": 1}'}}).encode()

    def urlopen(request, timeout):
        sent.append((request.full_url, json.loads(request.data), timeout))
        return Response()

    monkeypatch.setattr(clients.urllib.request, "urlopen", urlopen)
    answer = ChatClient("http://model.invalid/api/chat", "some-model", 5)()
    messages = replies.request_messages("p", "text")
    assert answer([messages], SPEC.json_schema()) == ['{"classification": 1}']
    url, body, timeout = sent[0]
    assert (url, timeout) == ("http://model.invalid/api/chat", 5)
    assert body == {
        "model": "some-model",
        "messages": messages,
        "format": SPEC.json_schema(),
        "stream": False,
    }


OTHER = LabelSpec("other", "Answer with the number in the name.")


def test_several_labels_in_one_map(spark):
    rows = [(0, "1", "7"), (1, "x", "8"), (2, "2", ""), (3, "boom", None)]
    df = spark.createDataFrame(rows, "n int, t string, name string")
    out = infer_labels(df, [("t", SPEC), ("name", OTHER)], ScriptedClient(), "quarantine")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert labels_of(out) == {
        0: (1, 7, None),
        1: (None, 8, f"label: {replies.BAD_JSON}"),
        2: (2, None, f"other: {replies.EMPTY_INPUT}"),
        3: (None, None, f"label: {replies.CLIENT_ERROR}: no answer; other: {replies.EMPTY_INPUT}"),
    }
    reused = classify_labels(df, [("t", SPEC), ("name", OTHER)], ScriptedClient(), "quarantine", reuse_answers=True)
    assert labels_of(reused) == labels_of(out)
    for bad in ([], [("t", SPEC), ("name", SPEC)]):
        with pytest.raises(ValueError):
            infer_labels(df, bad, ScriptedClient())


def labels_of(df):
    return {r.n: tuple(r[3:]) for r in df.collect()}


def test_a_failure_counts_for_its_request_alone(spark, tmp_path):
    texts = [str(n) for n in range(31)] + ["boom"]
    df = infer(table(spark, texts, 1), "t", SPEC, ScriptedClient(str(tmp_path)), "quarantine")
    assert sum(error is not None for _, error in labels(df).values()) == 1
    assert sorted(sum(calls(tmp_path), [])) == sorted(texts)


def test_a_restarted_run_asks_for_the_rest(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "answers")
    log.mkdir()
    texts = [str(n) for n in range(31)] * 3 + ["boom"]
    client = ScriptedClient(str(log))

    def run(texts):
        scratch = []
        found = classify(table(spark, texts), "t", SPEC, client, answers=AnswerTable(store), scratch=scratch)
        out = labels(found)
        for shared in scratch:
            drop_shared(shared)
        return out

    with pytest.raises(LabelError):
        run(texts)
    with pytest.raises(LabelError):
        run(texts)
    asked = sum(calls(log), [])
    assert all(asked.count(str(n)) == 1 for n in range(31)) and asked.count("boom") == 2
    assert run(texts[:-1]) == {n: (int(t),) for n, t in enumerate(texts[:-1])}
    assert len(sum(calls(log), [])) == len(asked)
    # Another prompt is another question.
    classify(table(spark, ["3"]), "t", OTHER, client, answers=AnswerTable(store)).collect()
    assert sum(calls(log), []).count("3") == 2


def test_failed_requests_are_told_and_asked_again(spark, tmp_path):
    store = str(tmp_path / "answers")
    for _ in range(2):
        df = classify(
            table(spark, ["1", "boom", "", None, "x"]), "t", SPEC, ScriptedClient(), "quarantine",
            answers=AnswerTable(store),
        )
        assert labels(df) == {
            0: (1, None),
            1: (None, f"{replies.CLIENT_ERROR}: no answer"),
            2: (None, replies.EMPTY_INPUT),
            3: (None, replies.EMPTY_INPUT),
            4: (None, replies.BAD_JSON),
        }


def test_input_is_computed_once_when_answers_are_reused(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = table(spark, ["1", "2", "1"]).mapInArrow(count, "n int, t string")
    assert len(labels(classify(df, "t", SPEC, ScriptedClient(), reuse_answers=True))) == 3
    assert seen.value == 3


@dataclass(frozen=True)
class SlowClient:
    seconds: float = 0.1

    def __call__(self):
        lock, running = threading.Lock(), [0, 0]

        def answer(requests, schema):
            with lock:
                running[0] += 1
                running[1] = max(running)
            time.sleep(self.seconds)
            with lock:
                running[0] -= 1
            return [json.dumps({"classification": running[1]}) for _ in requests]

        return answer


def test_calls_in_flight_are_bounded_and_in_order():
    specs, texts = [SPEC], [str(n) for n in range(32)]
    start = time.perf_counter()
    with classify_module._Asker(SlowClient()(), specs, 1, 8, True) as asker:
        most = [label for label, _ in asker.answers([(SPEC, t) for t in texts])]
    assert time.perf_counter() - start < 0.7
    assert max(most) == 8
    with classify_module._Asker(ScriptedClient()(), specs, 3, 4, True) as asker:
        answers = list(asker.answers([(SPEC, t) for t in ["5", "", "boom", "6", "x"] * 9]))
    assert answers[:5] == [
        (5, None), (None, replies.EMPTY_INPUT), (None, f"{replies.CLIENT_ERROR}: no answer"),
        (6, None), (None, replies.BAD_JSON),
    ] and answers == answers[:5] * 9


def test_calls_in_flight_give_the_same_rows(spark):
    texts = [str(n % 5) for n in range(200)]
    one = infer(table(spark, texts), "t", SPEC, ScriptedClient())
    many = infer(table(spark, texts), "t", SPEC, ScriptedClient(), in_flight=6, batch_size=4)
    assert labels(one) == labels(many)
    with pytest.raises(PythonException):
        infer(table(spark, [*texts, "boom"]), "t", SPEC, ScriptedClient(), in_flight=6).collect()


def test_by_prompt_client():
    answer = clients.ByPromptClient(((SPEC.prompt, TermsClient(("a",))), (OTHER.prompt, TermsClient(("b",)))))()
    requests = [replies.request_messages(spec.prompt, "a") for spec in (SPEC, OTHER)]
    assert answer(requests, {}) == ['{"classification": 1}', '{"classification": 0}']


def test_label_schema_of_a_request():
    schema = SPEC.json_schema()
    assert schema["required"] == [replies.FIELD] and schema["properties"][replies.FIELD]["type"] == "integer"
    assert SPEC.key() == LabelSpec("renamed", SPEC.prompt).key() != OTHER.key()

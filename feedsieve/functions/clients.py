"""Model clients.

A client factory is a picklable callable without arguments.  It is called once
per task and returns the client: ``(list of messages, json schema) -> list of
reply texts``.  An exception in the place of a reply counts for its request
alone.  A client may be called from several threads at a time.
"""

import json
import re
import urllib.request
from dataclasses import dataclass

from . import fixed_values as fixed
from .replies import FIELD
from .text import fold_text, is_plain, needed_terms


def _reply(label):
    return json.dumps({FIELD: int(label)})


def _any_of(terms):
    return lambda text: any(term in text for term in terms)


def _user_text(messages):
    return messages[-1]["content"]


def _or_exception(ask, messages, schema):
    try:
        return ask(messages, schema)
    except Exception as problem:
        return problem


@dataclass(frozen=True)
class ByPromptClient:
    """Answers each prompt with a client of its own: pairs ``(prompt, client factory)``."""

    factories: tuple

    def __call__(self):
        clients = {prompt: factory() for prompt, factory in self.factories}

        def answer(requests, schema):
            return [clients[messages[0]["content"]]([messages], schema)[0] for messages in requests]

        return answer


@dataclass(frozen=True)
class TermsClient:
    """Answers 1 where one of the terms occurs, case ignored; needs no model."""

    terms: tuple

    def __call__(self):
        def answer(requests, schema):
            texts = (_user_text(messages).lower() for messages in requests)
            return [_reply(any(term in text for term in self.terms)) for text in texts]

        return answer


@dataclass(frozen=True)
class RuleClient:
    """Answers with the keyword and indicator rule; needs no model.

    The same rule as ``text.is_job_post``, for one text at a time.
    """

    keywords: tuple = fixed.JOB_KEYWORDS

    def __call__(self):
        if all(map(is_plain, self.keywords)):
            has_keyword = _any_of(needed_terms(k.lower() for k in self.keywords))
        else:
            has_keyword = re.compile("|".join(self.keywords), re.IGNORECASE).search
        has_requirement = _any_of(fixed.REQUIREMENT_WORDS)
        has_experience = re.compile("|".join(fixed.EXPERIENCE_PATTERNS)).search
        has_action = _any_of(fixed.ACTION_WORDS)
        words = (fixed.RESUME_WORD, fixed.CV_WORD, fixed.POSITION_WORD, fixed.ROLE_WORD)

        def is_job_post(text):
            folded, lowered = fold_text(text), text.lower()
            if not has_keyword(folded):
                return False
            count = sum(word in lowered for word in words)
            count += has_requirement(folded) + has_action(folded)
            count += fixed.EXPERIENCE_WORD in folded and has_experience(folded) is not None
            return count >= fixed.MIN_INDICATORS

        def answer(requests, schema):
            return [_reply(is_job_post(_user_text(messages))) for messages in requests]

        return answer


@dataclass(frozen=True)
class ChatClient:
    """Asks a chat endpoint that takes a JSON schema as ``format``.

    One request per row, as the endpoint offers no batches; the number of tasks
    and of calls in flight decide how many run at a time.
    """

    endpoint: str
    model: str = fixed.MODEL_NAME
    timeout_seconds: float = 300.0

    def __call__(self):
        def ask(messages, schema):
            body = {"model": self.model, "messages": messages, "format": schema, "stream": False}
            request = urllib.request.Request(
                self.endpoint,
                data=json.dumps(body).encode(),
                headers={"Content-Type": "application/json"},
            )
            with urllib.request.urlopen(request, timeout=self.timeout_seconds) as response:
                return json.load(response)["message"]["content"]

        def ask_each(requests, schema):
            if len(requests) == 1:
                return [ask(requests[0], schema)]
            return [_or_exception(ask, messages, schema) for messages in requests]

        return ask_each

"""Language models behind one function: (system, user) -> reply.  Offline there is only the stub; nothing here opens a connection."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.sources.tables import in_batches

Completer = Callable[[str, str], str]

#: Attempts per call, and the answers worth another attempt.
ATTEMPTS, RETRY_STATUS = 4, frozenset({408, 409, 429})


class ModelError(Exception):
    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status

    @property
    def temporary(self) -> bool:
        return self.status is None or self.status in RETRY_STATUS or self.status >= 500


def with_retries(complete: Completer, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Completer:
    """Temporary failures are tried again after 2, 4, 8 seconds; others at once end the call."""

    def call(system: str, user: str) -> str:
        for n in range(1, attempts + 1):
            try:
                return complete(system, user)
            except ModelError as e:
                if not e.temporary or n == attempts:
                    raise
                wait(2.0**n)
        raise AssertionError

    return call


def text_of(message: dict) -> str:
    """The text of a reply message; a reply that was cut off, or has no text, is an error."""
    if message.get("stop_reason") == "max_tokens":
        raise ModelError("the reply was cut off", 400)
    text = "".join(b.get("text", "") for b in message.get("content", []) if b.get("type") == "text")
    if not text:
        raise ModelError("the reply has no text", 400)
    return text


def stub(system: str, user: str) -> str:
    """A deterministic stand-in: the first lines of what it was given."""
    return "\n".join(x for x in user.split("\n") if x.strip())[:400]


def complete_rows(df: DataFrame, key: str, prompt: str, system: str, complete: Completer = stub) -> DataFrame:
    """(key, reply, error), one call per row, in the workers; a failed call is an error on its row, and a null prompt makes no call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = with_retries(complete)
        for batch in batches:
            replies, errors = [], []
            for p in batch.column(1).to_pylist():
                reply, error = None, None
                if p is not None:
                    try:
                        reply = call(system, p)
                    except ModelError as e:
                        error = str(e)
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[key, "reply", "error"])

    return in_batches(df.select(key, prompt), run, f"`{key}` {df.schema[key].dataType.simpleString()}, reply string, error string")

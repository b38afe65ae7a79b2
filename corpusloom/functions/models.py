"""Model calls as injected callables over Arrow batches: retries, fatal errors, errors as data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.sources import files

RESULT = "ok boolean, reply string, error string, attempts int, latency_s double"
# Status codes after which further calls are pointless, and those worth another try.
FATAL, TRANSIENT = (401, 402, 403), (408, 409, 425, 429, 500, 502, 503, 504)


class ModelError(Exception):
    """An error of a model call; ``code`` is the HTTP status, ``truncated`` that the reply was cut for its length."""

    def __init__(self, message: str, code: int | None = None, truncated: bool = False) -> None:
        super().__init__(message)
        self.code, self.truncated = code, truncated


class FatalModelError(RuntimeError):
    """Ends the job: no later row would succeed."""


def call(model: Callable[[str, bool], str], prompt: str, tries: int = 3, valid: Callable[[str], bool] | None = None, wait: Callable[[float], None] = time.sleep) -> tuple[bool, str | None, str | None, int]:
    """``(ok, reply, error, attempts)`` of one prompt.

    The second argument of ``model`` asks for less reasoning, after a reply that was cut for its length. Transient
    errors and replies that are not ``valid`` are tried again after min(2^n, 20) seconds; a fatal one is raised.
    """
    error, brief = "no try", False
    for n in range(tries):
        try:
            reply = model(prompt, brief)
            if valid is None or valid(reply):
                return True, reply, None, n + 1
            error = "invalid reply"
        except ModelError as e:
            error = str(e)
            if e.code in FATAL:
                raise FatalModelError(error) from e
            if e.truncated:
                brief = True
            elif e.code is not None and e.code not in TRANSIENT:
                return False, None, error, n + 1
        if n + 1 < tries:
            wait(min(2.0**n, 20.0))
    return False, None, error, tries


def classify(df: DataFrame, prompt: str, model: Callable[[str, bool], str], tries: int = 3, valid: Callable[[str], bool] | None = None, wait: Callable[[float], None] = time.sleep, concurrency: int | None = None, stop: str | None = None) -> DataFrame:
    """``df`` with ok, reply, error, attempts, latency_s; a failed row is a row with its error.

    ``concurrency`` caps the tasks that call the model at once. Null prompts are not sent. A fatal error ends the job; or,
    with the path of a file in shared storage as ``stop``, it becomes the error of its row, which begins with ``fatal: ``.
    The file is then made, the rows that have not been sent yet are left out in all tasks, and those that are finished
    stay; a fatal error that comes second counts as not sent. Calls are never repeated: use the result once.
    """
    rows = df.repartition(concurrency) if concurrency else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, sent = [], []
            for text in batch[prompt]:
                began = time.time()
                sent.append(stop is None or not files.exists(stop))
                try:
                    got = (False, None, "null prompt", 0) if text is None or not sent[-1] else call(model, text, tries, valid, wait)
                except FatalModelError as e:
                    if stop is None:
                        raise
                    sent[-1] = files.claim(stop, str(e).encode())
                    got = (False, None, f"fatal: {e}", 1)
                out.append((*got, time.time() - began))
            if not all(sent):
                out = [x for x, s in zip(out, sent) if s]
                batch = pd.DataFrame({c: pd.Series([x for x, s in zip(batch[c].tolist(), sent) if s], dtype=object if isinstance(batch[c].dtype, pd.StringDtype) else batch[c].dtype) for c in batch.columns})
            if not out:
                continue
            yield batch.assign(**{name: [x[i] for x in out] for i, name in enumerate(("ok", "reply", "error", "attempts", "latency_s"))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, {RESULT}")


def enrich(df: DataFrame, key: str, fetch: Callable[[str], str], tries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Context of each distinct key by an injected ``fetch``: key, status (ok or error), context, error."""
    done = classify(df.select(key).where(f"`{key}` IS NOT NULL").distinct(), key, lambda k, _: fetch(k), tries, None, wait)
    return done.selectExpr(f"`{key}`", "CASE WHEN ok THEN 'ok' ELSE 'error' END AS status", "reply AS context", "error")

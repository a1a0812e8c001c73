"""Model hooks: labellers, enrichers and embedders are callables that run in the tasks, with bounded retries.

A hook is any picklable callable. Without a network there is none here; the
tests bring deterministic ones.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.vocabulary import ATTEMPTS, BACKOFF_CAP, THREADS


def temperature(attempt: int) -> float:
    """0 at first; then a little warmer with each attempt, up to 0.75. The numbers are fixed values."""
    return 0.0 if attempt <= 0 else min(0.75, math.log(attempt**0.2) + 0.15)


def backoff(failures: int) -> int:
    return min(2**failures, BACKOFF_CAP)


def is_transient(error: Exception) -> bool:
    """Lost connections, time-outs, status 429 and 5xx are worth another try; other statuses and unknown errors are not."""
    status = getattr(error, "status_code", None)
    if status is not None:
        return status == 429 or status >= 500
    return isinstance(error, (ConnectionError, TimeoutError))


def retry_note(why: str) -> str:
    return f"The last answer was not accepted: {why}. Answer again, correct in this respect."


class NoAnswer(ValueError):
    """The model was asked as often as allowed, and no answer passed the check."""


def call(model: Callable, payload: str, check: Callable | None = None, attempts: int = ATTEMPTS, sleep: Callable = time.sleep):
    """The first answer that ``check`` accepts; what it had against earlier ones goes along as notes.

    ``model(payload, notes, temperature)`` answers; ``check(payload, answer)`` gives
    None or what is wrong. A transient error is tried again after a pause, any other
    one is raised, and so is the last failure.
    """
    notes: list[str] = []
    failures = 0
    for attempt in range(attempts):
        try:
            answer = model(payload, notes, temperature(attempt))
        except Exception as error:
            if not is_transient(error) or attempt == attempts - 1:
                raise
            failures += 1
            sleep(backoff(failures))
            continue
        why = check(payload, answer) if check else None
        if why is None:
            return answer
        notes.append(retry_note(why))
    raise NoAnswer(f"no valid answer in {attempts} attempts: {notes[-1] if notes else 'the model did not answer'}")


class Pace:
    """Lets ``per_second`` calls through in a second, evenly, whichever thread they come from; without a number, all at once."""

    def __init__(self, per_second: float | None, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.gap, self.clock, self.sleep = 1 / per_second if per_second else 0.0, clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                now = self.clock()
                at = max(now, self.next)
                self.next = at + self.gap
            self.sleep(at - now)


def in_order(work: Callable, items: list, threads: int) -> list:
    """``work`` of each item, in their order, up to ``threads`` at a time. After an error no further item is begun."""
    if threads <= 1:
        return [work(x) for x in items]
    with ThreadPoolExecutor(threads) as pool:
        calls = [pool.submit(work, x) for x in items]
        try:
            return [c.result() for c in calls]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def answered(
    payloads: DataFrame, model: Callable, schema: str, check: Callable | None = None, column: str = "payload", attempts: int = ATTEMPTS,
    threads: int = THREADS, per_second: float | None = None,
) -> DataFrame:
    """``payloads`` with ``answer``, what the model makes of each, parsed by ``schema``, and ``failure``.

    Each task calls the model from ``threads`` threads, at most ``per_second``
    times a second; answers keep the order of their payloads. A payload for
    which no answer passes ``check``, or whose answer ``schema`` cannot parse,
    keeps its row: it has a null answer and says why in ``failure``.
    """

    @F.pandas_udf("struct<raw: string, failure: string>")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_second)

        def paced(*told):
            pace.wait()
            return model(*told)

        def one(payload: str) -> tuple[str | None, str | None]:
            try:
                return call(paced, payload, check, attempts), None
            except NoAnswer as error:
                return None, str(error)

        for texts in batches:
            yield pd.DataFrame(in_order(one, list(texts), threads), columns=["raw", "failure"])

    told = payloads.withColumn("_told", asked(F.col(column)))
    told = told.withColumn("answer", F.from_json("_told.raw", schema, {"mode": "PERMISSIVE"}))
    empty = F.col("_told.failure").isNull() & F.coalesce(F.to_json("answer") == "{}", F.lit(True))
    return told.withColumn("failure", F.when(empty, "the answer is not of the agreed form").otherwise(F.col("_told.failure"))).drop("_told")


def insisted(work: Callable, attempts: int = ATTEMPTS, sleep: Callable = time.sleep):
    """What ``work`` gives; transient errors are tried again after a pause, any other one and the last are raised."""
    for attempt in range(1, attempts + 1):
        try:
            return work()
        except Exception as error:
            if not is_transient(error) or attempt == attempts:
                raise
            sleep(backoff(attempt))


def embedded(
    rows: DataFrame, text: str, out: str, embed: Callable[[list[str]], list[list[float]]], size: int = 256, attempts: int = ATTEMPTS, sleep: Callable = time.sleep
) -> DataFrame:
    """``rows`` with vectors of ``text``, made in slices of ``size`` texts, each tried again after transient errors; a null text has a null vector."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            here = texts.dropna()
            made: list = []
            for at in range(0, len(here), size):
                made += insisted(lambda some=here.iloc[at : at + size].tolist(): embed(some), attempts, sleep)
            yield pd.Series(made, index=here.index, dtype=object).reindex(texts.index)

    return rows.withColumn(out, vectors(F.col(text)))

"""The boundary to language models: any function of a prompt; offline a stub stands in for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Backend(Protocol):
    def __call__(self, prompt: str) -> str: ...


def stub() -> Backend:
    """Answers every prompt with an empty list of propositions."""
    return lambda prompt: '{"caps": []}'


def generate(df: DataFrame, make: Callable[[], Backend] = stub, *, key: str = "case_id", prompt: str = "prompt", retries: int = 2) -> DataFrame:
    """(key, response, error): one backend a task, tried again on failure; the last error is kept, not raised."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for f in frames:
            out = []
            for p in f[prompt]:
                answer, error = None, None
                for _ in range(retries + 1):
                    try:
                        answer, error = ask(p), None
                        break
                    except Exception as e:  # the row says what failed
                        error = repr(e)
                out.append((answer, error))
            yield pd.DataFrame({key: f[key], "response": [a for a, _ in out], "error": [e for _, e in out]})

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, response string, error string")

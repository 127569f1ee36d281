"""Optional live completions: a caller's function over rendered prompts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from broadsheet.schemas import RESPONSE

# prompt -> any of text, status, error, provider, model, tokens_in, tokens_out
Completer = Callable[[str], dict]

_TEXT = ("text", "error", "provider", "model")
_COUNTS = ("tokens_in", "tokens_out")


def complete(prompts: DataFrame, completer: Completer) -> DataFrame:
    """Response rows for prompts (seq, stage, prompt).

    Runs in Arrow batches on the executors. An exception of the completer becomes a row
    with status ``api_error``; no prompt is lost and no call stops the job.
    """

    def call(prompt: str) -> dict:
        started = time.monotonic()
        try:
            answer = dict(completer(prompt))
        except Exception as problem:  # any failure of a remote call is a row status
            answer = {"status": "api_error", "error": str(problem)}
        answer.setdefault("status", "ok")
        answer.setdefault("latency_ms", int((time.monotonic() - started) * 1000))
        return answer

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [call(p) for p in batch["prompt"]]
            out = pd.DataFrame({"seq": batch["seq"].to_numpy(), "stage": batch["stage"].to_numpy()})
            out["status"] = [a["status"] for a in answers]
            out["latency_ms"] = [int(a["latency_ms"]) for a in answers]
            for name in _TEXT:
                out[name] = [str(a.get(name, "")) for a in answers]
            for name in _COUNTS:
                out[name] = [int(a.get(name, 0)) for a in answers]
            yield out[[c.split()[0] for c in RESPONSE.split(", ")]]

    return prompts.select("seq", "stage", "prompt").mapInPandas(run, RESPONSE)

"""Notes on the top hunks of each diff, joined back as signals without points.

Notes come from a backend, which explains the top hunks of a diff in one call. Which one is named by an
environment variable; ``echo`` needs no model and no network.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.signals import none, signal
from hunkwise.operators.parse import header

TOP = 3
#: Names the backend.
VARIABLE = "HUNKWISE_LLM_BACKEND"


class EnrichmentError(RuntimeError):
    """Notes were asked for and cannot be had."""


class Backend(Protocol):
    def explain(self, requests: Sequence[Mapping[str, Any]]) -> dict[str, str]:
        """Notes by hunk id, for some or all requests (id, file_path, header, body, score) of one diff."""
        ...


class EchoBackend:
    """Says how long each change is."""

    def explain(self, requests: Sequence[Mapping[str, Any]]) -> dict[str, str]:
        def count(body: str, sign: str) -> int:
            return sum(x.startswith(sign) and not x.startswith(sign * 3) for x in body.split("\n"))

        return {r["id"]: f"[echo] {r['file_path']}: review this change (+{count(r['body'], '+')}/-{count(r['body'], '-')} lines); check edge cases and error handling." for r in requests}


#: Backends by name, made from the environment.
BACKENDS: dict[str, Callable[[Mapping[str, str]], Backend]] = {"echo": lambda env: EchoBackend()}


def resolve_backend(env: Mapping[str, str] | None = None) -> Backend:
    env = os.environ if env is None else env
    name = (env.get(VARIABLE) or "").strip().lower()
    known = ", ".join(sorted(BACKENDS))
    if not name:
        raise EnrichmentError(f"no backend is named; set {VARIABLE} to one of: {known}")
    if name not in BACKENDS:
        raise EnrichmentError(f"unknown backend {name!r}; set {VARIABLE} to one of: {known}")
    return BACKENDS[name](env)


def requests(hunks: DataFrame, top: int = TOP) -> DataFrame:
    """diff_id, id, file_path, header, body, score of the first ranked hunks of each diff."""
    return hunks.where(F.col("rank") <= max(0, top)).select("diff_id", "id", "file_path", header().alias("header"), "body", "score")


def notes_of(asked: DataFrame, backend: Backend) -> DataFrame:
    """diff_id, id, note: one call of the backend for each diff, on the executors. Requests are at most ``top`` a diff."""
    kind = asked.schema["diff_id"].dataType.simpleString()

    def explain(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        try:
            said = backend.explain(rows.drop(columns="diff_id").to_dict("records"))
        except EnrichmentError:
            raise
        except Exception as e:
            raise EnrichmentError(f"the backend failed: {e}") from e
        if not isinstance(said, Mapping):
            raise EnrichmentError("the backend gave no mapping of ids to notes")
        wanted = {i: n for i, n in said.items() if isinstance(n, str)}
        return pd.DataFrame({"diff_id": [key[0]] * len(wanted), "id": list(wanted), "note": list(wanted.values())})

    return asked.groupBy("diff_id").applyInPandas(explain, f"diff_id {kind}, id string, note string")


def echo_notes(asked: DataFrame) -> DataFrame:
    """What ``EchoBackend`` says, as columns."""
    count = lambda one, three: F.size(F.filter(F.split("body", "\n"), lambda x: F.startswith(x, F.lit(one)) & ~F.startswith(x, F.lit(three)))).cast("string")
    note = F.concat(F.lit("[echo] "), "file_path", F.lit(": review this change (+"), count("+", "+++"), F.lit("/-"), count("-", "---"), F.lit(" lines); check edge cases and error handling."))
    return asked.select("diff_id", "id", note.alias("note")).distinct()


def with_notes(hunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Append notes (diff_id, id, note) to the signals of hunks with the id; blank notes are left out."""
    clean = F.trim(F.regexp_replace("note", r"\s+", " "))
    said = notes.withColumn("_note", clean).where("_note != ''").groupBy("diff_id", "id").agg(F.min("_note").alias("_note"))
    # notes are few a diff: one map for each diff, and hunks stay where the ranking has put them
    said = said.groupBy("diff_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "_note"))).alias("_notes"))
    added = F.when(F.col("_note").isNull(), none()).otherwise(F.array(signal("llm", 0, F.concat(F.lit("model: "), "_note"))))
    out = hunks.join(said, "diff_id", "left").withColumn("_note", F.try_element_at("_notes", F.col("id")))
    return out.withColumn("signals", F.concat("signals", added)).drop("_note", "_notes")


def enrich(hunks: DataFrame, backend: Backend | None = None, top: int = TOP, env: Mapping[str, str] | None = None) -> DataFrame:
    """Ranked hunks with the backend's notes on the first ``top`` of each diff; scores and ranks stay."""
    if top <= 0:
        return hunks
    return with_notes(hunks, notes_of(requests(hunks, top), backend or resolve_backend(env)))

"""Pluggable batch functions: embeddings and workers. A provider sees whole batches, never single rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Embed = Callable[[list[str]], list[list[float]]]


def echo(dimension: int = 8) -> Embed:
    """Deterministic vectors from a digest of the text; for tests and offline use."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.sha256((t or "").encode()).digest()[:dimension]] for t in texts]

    return embed


def embed_column(df: DataFrame, id_col: str, text_col: str, embed: Embed, dimension: int, batch: int = 64) -> DataFrame:
    """(id, vector): vectors of the wrong dimension raise."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                vectors = embed(part[text_col].tolist())
                if len(vectors) != len(part) or any(len(v) != dimension for v in vectors):
                    raise ValueError(f"the provider must return a vector of {dimension} numbers for each text")
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "vector": vectors})

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, vector array<double>")


def run_workers(tasks: DataFrame, backend: Callable[[dict], dict]) -> DataFrame:
    """Tasks (task_id, kind, payload JSON) through a backend to proposals (task_id, state, content, error)."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.itertuples():
                try:
                    answer = backend({"task_id": t.task_id, "kind": t.kind, **json.loads(t.payload or "{}")})
                    if not isinstance(answer.get("content"), str) or not answer["content"].strip():
                        raise ValueError("an answer needs content")
                    rows.append((t.task_id, "proposed", answer["content"], None))
                except Exception as e:  # a failed task is a row, not a failed job
                    rows.append((t.task_id, "failed", None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["task_id", "state", "content", "error"])

    return tasks.select("task_id", "kind", "payload").mapInPandas(run, "task_id long, state string, content string, error string")

"""Models as functions that the caller brings: texts in, texts or vectors out, a batch at a time, with what holds if they fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import vectors as V

BATCH = 64


def answered(df: DataFrame, prompt: str, ask: Callable[[list[str]], list[str | None]], column: str = "answer", batch: int = BATCH) -> DataFrame:
    """df with what ask makes of the texts in prompt, as column; null where prompt is null or a whole batch fails.

    ask runs on the executors and must be such that it can be sent there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[str | None] = []
            for at in range(0, len(frame), batch):
                given = frame[prompt].iloc[at : at + batch].tolist()
                some = [p for p in given if p is not None]
                try:
                    made = iter(ask(some) if some else [])
                    out += [None if p is None else next(made) for p in given]
                except Exception:  # the model's: its rows keep null, for the caller's fallback
                    out += [None] * len(given)
            yield frame.assign(**{column: pd.Series(out, index=frame.index, dtype=object)})

    return df.mapInPandas(run, f"{df.schema.toDDL()}, `{column}` string")


def embedded(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], width: int, column: str = "embedding", batch: int = BATCH) -> DataFrame:
    """df with embed's vectors of text, cut or filled with zeros to width; null for blank texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[list[float] | None] = []
            for at in range(0, len(frame), batch):
                given = frame[text].iloc[at : at + batch].tolist()
                made = iter(embed([t for t in given if t and t.strip()]) if any(t and t.strip() for t in given) else [])
                out += [list(map(float, next(made))) if t and t.strip() else None for t in given]
            yield frame.assign(_made=pd.Series(out, index=frame.index, dtype=object))

    rows = df.mapInPandas(run, f"{df.schema.toDDL()}, _made array<float>")
    return rows.withColumn(column, F.when(F.col("_made").isNotNull(), V.fit(F.col("_made"), width))).drop("_made")

"""A registry of named tools over DataFrames, and the product insight that combines them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import routing
from opinara.operators import metrics as M
from opinara.plans import search as H


@dataclass
class Tools:
    """Functions by name, each with an owner; asking for an unknown one raises KeyError."""

    found: dict[str, tuple[Callable[..., Any], str]] = field(default_factory=dict)

    def register(self, name: str, f: Callable[..., Any], owner: str) -> None:
        self.found[name] = (f, owner)

    def run(self, name: str, **given: Any) -> Any:
        if name not in self.found:
            raise KeyError(f"tool_not_found: {name}")
        return self.found[name][0](**given)


def default_tools() -> Tools:
    tools = Tools()
    for name, f, owner in (
        ("vector_search", H.vector_candidates, "researcher"),
        ("keyword_search", H.keyword_candidates, "researcher"),
        ("evidence", H.evidence, "researcher"),
        ("rag_query", H.answer_sources, "researcher"),
        ("question_kind", routing.question_kind, "router"),
        ("extract_entities", routing.capitalised, "router"),
        ("score_coverage", M.coverage, "critic"),
        ("check_grounding", M.grounding, "critic"),
        ("sentiment_breakdown", M.sentiment_histogram, "analyst"),
        ("top_tags", top_tags, "analyst"),
    ):
        tools.register(name, f, owner)
    return tools


def top_tags(citations: DataFrame, tags: str = "tags", n: int = 5) -> DataFrame:
    return M.topic_counts(citations, tags, 1, n, ",")


def product_insight(citations: DataFrame, product: str, sentiment: str = "sentiment", tags: str = "tags") -> DataFrame:
    """One row on a product's citations: positive, neutral, negative, top_tags (most frequent first) and a summary."""
    counts = M.sentiment_histogram(citations, sentiment)
    top = top_tags(citations, tags).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "topic"))).alias("t")).select(F.transform("t", lambda t: t["topic"]).alias("top_tags"))  # five at most
    row, whole = counts.crossJoin(top), lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")  # one row each
    frequent = F.coalesce(F.nullif(F.array_join("top_tags", ", "), F.lit("")), F.lit("нет данных"))
    summary = F.concat(F.lit(f"Товар: {product}. Позитив: "), whole("positive"), F.lit(", нейтраль: "), whole("neutral"), F.lit(", негатив: "), whole("negative"), F.lit(". Частые теги: "), frequent, F.lit("."))
    return row.withColumn("product_name", F.lit(product)).withColumn("summary", summary)


def persist_run(run: DataFrame, events: DataFrame, runs_path: str, events_path: str) -> None:
    """Appends a run and its events; events carry the run's id."""
    events.write.mode("append").parquet(events_path)
    run.write.mode("append").parquet(runs_path)


def has_source(df: DataFrame, source_id: object, external_id: object) -> bool:
    """Whether a source has a product already; one row is asked for."""
    return not df.where((F.col("source_id") == F.lit(source_id)) & (F.col("external_id") == F.lit(external_id))).limit(1).isEmpty()

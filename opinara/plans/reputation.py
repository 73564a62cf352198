"""Reputation of entities: reports and comparisons, as tables, and texts from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import entities as E
from opinara.operators import metrics as M

LEAST, MOST = 2, 6


class CompareError(ValueError):
    """need_at_least_two_entities, too_many_entities or scope_filtered_out."""


def canonical_reviews(raw: DataFrame) -> DataFrame:
    """Reviews with rating, answered and pos added, from the columns that a review has."""
    return raw.withColumn("rating", T.first_rating(F.col("rating_value"), F.col("rating_clinic"))).withColumn("answered", T.filled(F.col("answer")))


def research_table(reviews: DataFrame, by: list[str], texts: DataFrame | None = None) -> DataFrame:
    """All metrics of each entity in one row; texts (by, field, value) add a column for each field, blank by default."""
    table = M.entity_metrics(reviews, by).join(M.rank_metrics(reviews, by).drop("review_count"), by)
    if texts is None:
        return table
    wide = texts.groupBy(*by).pivot("field").agg(F.first("value"))
    return table.join(wide, by, "left").fillna("", [c for c in wide.columns if c not in by])


def report(reviews: DataFrame, by: list[str], text: str, themes: dict = M.THEMES, complaints: list[str] = M.COMPLAINTS, k: int = 3) -> DataFrame:
    """Metrics, the k most frequent complaints and praises, and the k riskiest reviews of each entity."""
    low = F.coalesce(F.nullif("rating", F.lit(0.0)), F.lit(10.0)) < M.LOW
    bad = M.theme_counts(reviews.where(low), text, themes, by).where(F.col("theme").isin(*complaints))
    good = M.theme_counts(reviews.where(F.col("rating") >= M.HIGH), text, themes, by).where(~F.col("theme").isin(*complaints))
    out = research_table(reviews, by)
    for name, counts in (("complaints", bad), ("praises", good)):
        top = M.top_per_group(counts, by, [F.col("n").desc(), F.col("theme")], k)
        listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "theme"))), lambda x: x["theme"])  # of k rows
        out = out.join(top.groupBy(*by).agg(listed.alias(name)), by, "left")
    risky = E.risk_reviews(reviews, k, by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "review_id"))), lambda x: x["review_id"]).alias("risk_ids"))
    return out.join(risky, by, "left")


def compare(reviews: DataFrame, ids: list[str], scope: dict[str, str] | None = None) -> DataFrame:
    """A row for each requested entity in the order asked for, over the reviews of a shared scope."""
    if len(ids) < LEAST:
        raise CompareError("need_at_least_two_entities")
    if len(ids) > MOST:
        raise CompareError("too_many_entities")
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("position"), F.lit(i).alias("entity_id")) for p, i in enumerate(ids)))).alias("w")
    asked = reviews.sparkSession.range(1).select(wanted).select("w.*")
    own = reviews.where(F.col("entity_id").isin(*ids))
    seen = E.in_scope(own, scope) if scope else own
    table = M.entity_metrics(seen, ["entity_id"]).join(M.response_status(seen, ["entity_id"]), "entity_id")
    totals = own.groupBy("entity_id").agg(F.count("*").alias("reviews_before_scope"))
    rows = asked.join(totals, "entity_id", "left").join(table, "entity_id", "left")
    rows = rows.withColumn("status", F.when(F.col("reviews_before_scope").isNull(), "not_found").when(F.col("total").isNull(), "scope_empty").otherwise("ok"))
    return rows.orderBy("position")


def compare_checked(reviews: DataFrame, ids: list[str], scope: dict[str, str] | None = None) -> DataFrame:
    """compare, or scope_filtered_out if the scope leaves nothing of any entity."""
    rows = compare(reviews, ids, scope)
    if scope and rows.where("status = 'ok'").isEmpty():
        raise CompareError("scope_filtered_out")
    return rows


def winners(rows: DataFrame) -> DataFrame:
    return M.winners(rows, "entity_id", ["avg_rating", "answered_pct", "review_count"], "position")


def report_text(row) -> str:
    """A paragraph on one row of report."""
    rating = "no rating" if row["avg_rating"] is None else f"a mean rating of {row['avg_rating']:.1f}"
    parts = [f"{row['review_count']} reviews with {rating}; {row['unanswered_pct']:.1f} % without an answer."]
    for name in ("complaints", "praises"):
        if row[name]:
            parts.append(f"Most frequent {name}: {', '.join(row[name])}.")
    return " ".join(parts)


def snippets_merged(negative: DataFrame, general: DataFrame) -> DataFrame:
    """Snippets of negative queries first; each chunk once, those without an id by title and first 80 characters."""
    both = negative.withColumn("late", F.lit(0)).unionByName(general.withColumn("late", F.lit(1)))
    key = F.coalesce(F.col("chunk_id").cast("string"), F.concat_ws("|", "title", F.substring("text", 1, 80)))
    first = Window.partitionBy(key).orderBy("late", "pos")
    return both.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")

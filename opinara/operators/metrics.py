"""Metrics of entities, themes, topics and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import prefix

LOW, HIGH = 7.0, 8.0
#: Themes and what texts about them contain.
THEMES = {
    "компетентность и квалификация врача": ("квалифиц", "компетент", "профессион", "грамотн", "опытн", "эксперт"),
    "вежливость и внимательное отношение": ("вежлив", "внимательн", "доброжелатель", "приветлив", "терпелив"),
    "понятные объяснения врача": ("объясн", "рассказал", "разъясн", "ответил на вопрос", "подробно"),
    "качество результата лечения": ("результат", "вылечил", "помог", "удалил", "эффект", "всё удалили"),
    "быстрое обслуживание": ("быстр", "оператив", "без очеред", "сразу", "не ждал"),
    "удобная запись и расположение": ("удобн", "запис", "расположен", "легко добраться", "парков", "рядом"),
    "адекватная цена": ("недорог", "приемлем", "адекватн.*цен", "соотношен.*цен"),
    "чистота и комфорт в клинике": ("чист", "комфорт", "уют", "современн", "оборудован"),
    "долгое ожидание и очереди": ("очеред", "ждал", "ожидан", "долго жд", "час"),
    "высокая цена": ("дорог", "высок.*цен", "переплат", "завышен"),
    "грубость и плохое отношение": ("груб", "хамств", "невежлив", "неуважен", "не понравилось отношение"),
    "ошибки диагностики и лечения": ("ошиб", "неправильн", "не помог", "ухудш", "осложнен"),
    "проблемы с записью и администрацией": ("не запис", "отмен", "перенос", "администрац", "регистратур"),
    "скрытые доплаты и прозрачность цены": ("доплат", "навяз", "не предупред", "скрыт.*цен"),
    "качество обслуживания в целом": ("на высшем", "отличн", "рекоменд", "доволен", "супер"),
}
#: Themes that count as complaints; the others as praise.
COMPLAINTS = [
    "долгое ожидание и очереди",
    "высокая цена",
    "грубость и плохое отношение",
    "ошибки диагностики и лечения",
    "проблемы с записью и администрацией",
    "скрытые доплаты и прозрачность цены",
]


def entity_metrics(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Of reviews (rating, answered, doctor_id, doctor_name, created): count, mean, shares (to a digit), doctors, latest day."""
    rated = F.count("rating")
    doctor = F.when(T.filled(F.col("doctor_name")), F.coalesce(F.col("doctor_id").cast("string"), F.col("doctor_name")))
    return reviews.groupBy(*by).agg(
        F.count("*").alias("review_count"),
        T.round_exact(F.avg("rating"), 1).alias("avg_rating"),
        T.round_exact(F.lit(100.0) * F.count_if(F.col("rating") < LOW) / F.nullif(rated, F.lit(0)), 1).alias("negative_pct"),
        T.round_exact(F.lit(100.0) * F.count_if(~F.col("answered")) / F.count("*"), 1).alias("unanswered_pct"),
        F.count_distinct(doctor).alias("doctor_count"),
        F.max(F.substring(F.col("created").cast("string"), 1, 10)).alias("latest"),
    )


def rank_metrics(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Upper median and tenth percentile by index, and unanswered low ratings.

    Ratings are first counted by value. The value at an index is the one before which fewer, and up to which more are: running counts
    in ranges of entities and ratings, so that no task gathers an entity's ratings, however many different ones it has.
    """
    counts = reviews.groupBy(*by, "rating").agg(F.count("*").alias("n"), F.count_if((F.col("rating") < LOW) & ~F.col("answered")).alias("low"))
    counts = prefix.in_ranges(counts, by, ["rating"])
    rated = F.when(F.col("rating").isNotNull(), F.col("n")).otherwise(0)
    whole = counts.groupBy(*by).agg(F.sum("n").alias("review_count"), F.sum("low").alias("negative_unanswered"), F.sum(rated).alias("total"))
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
    upto = F.col("earlier") + F.col("n")
    placed = prefix.before(counts.where("rating is not null"), by, "block", ["rating"], {"earlier": F.col("n")}).withColumn("upto", upto)
    placed = placed.join(whole.select(*(F.col(c).alias(n) for c, n in names.items()), "total"), same).drop(*names.values())
    at = lambda i: F.min(F.when((F.col("earlier") <= i) & (i < F.col("upto")), F.col("rating")))
    tenth = F.greatest(F.lit(0), F.floor(F.col("total") * 0.1) - 1)
    ranks = placed.groupBy(*by).agg(at(F.floor(F.col("total") / 2)).alias("median_rating"), at(tenth).alias("p10_rating"))
    ranks = ranks.select(*(F.col(c).alias(n) for c, n in names.items()), "median_rating", "p10_rating")
    return whole.drop("total").join(ranks, same, "left").drop(*names.values())


def response_status(reviews: DataFrame, by: list[str]) -> DataFrame:
    share = F.lit(100.0) * F.count_if(F.col("answered")) / F.nullif(F.count("*"), F.lit(0))
    return reviews.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("answered")).alias("answered"), F.count_if(~F.col("answered")).alias("unanswered"), T.round_exact(share, 1).alias("answered_pct"))


def top_entities(reviews: DataFrame, name: str, n: int) -> DataFrame:
    return reviews.where(F.col(name) != "").groupBy(name).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), name).limit(n)


def theme_counts(df: DataFrame, text: str, themes: dict[str, tuple[str, ...]] = THEMES, by: list[str] | None = None) -> DataFrame:
    """(by, theme, n): texts that match a theme's patterns, each once. One pass; unmatched themes have no row."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array(*(F.when(low.rlike("|".join(patterns)), F.lit(label)) for label, patterns in themes.items()))
    return df.select(*(by or []), F.explode(F.array_compact(hits)).alias("theme")).groupBy(*(by or []), "theme").agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def topic_counts(df: DataFrame, topics: str, least: int = 2, n: int = 80, pattern: str = "[,;]") -> DataFrame:
    each = df.select(F.explode(T.split_topics(F.col(topics), least, pattern)).alias("topic"))
    return each.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "topic").limit(n)


def sentiment_histogram(df: DataFrame, text: str) -> DataFrame:
    kind = T.sentiment(F.col(text))
    return df.agg(*(F.count_if(kind == k).alias(k) for k in ("positive", "negative", "neutral")))


def run_kpi(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.coalesce(T.round_exact(F.avg("confidence"), 3), F.lit(0.0)).alias("avg_confidence"))


def review_kpi(reviews: DataFrame, low: float = 2.0, high: float = 4.0) -> DataFrame:
    """Count, mean, and shares of low and high ratings; 0 without rows."""
    n = F.nullif(F.count("*"), F.lit(0))
    zero = lambda c, name: F.coalesce(T.round_exact(c, 3), F.lit(0.0)).alias(name)
    return reviews.agg(F.count("*").alias("reviews"), zero(F.avg("rating"), "avg_rating"), zero(F.count_if(F.col("rating") <= low) / n, "negative_ratio"), zero(F.count_if(F.col("rating") >= high) / n, "positive_ratio"))


def daily_series(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("runs"), T.round_exact(F.avg("confidence"), 3).alias("avg_confidence")).orderBy("date")


def compared_by(reviews: DataFrame, by: list[str]) -> DataFrame:
    """What winners are told by, unrounded: of two means that look alike to a digit one is still the greater."""
    return reviews.groupBy(*by).agg(F.avg("rating").alias("avg_rating"), (F.lit(100.0) * F.count_if(F.col("answered")) / F.count("*")).alias("answered_pct"), F.count("*").alias("review_count"))


def winners(metrics: DataFrame, entity: str, columns: list[str], position: str) -> DataFrame:
    """One row: for each metric the entity with the most, the first in position of equals."""
    return metrics.agg(*(F.max_by(entity, F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col(position)))).alias(c) for c in columns))


def shared_themes(tops: DataFrame, entities: int, n: int = 4) -> DataFrame:
    """Themes of all entities' lists, in order of name; if there are none, the first n, most frequent first, of max(2, half of them).
    Of equally frequent themes the first by name comes first."""
    spread = tops.groupBy("theme").agg(F.count_distinct("entity_id").alias("n"))
    common = spread.where(F.col("n") == entities)
    least = max(2, (entities + 1) // 2)
    some = spread.where(F.col("n") >= least).crossJoin(F.broadcast(common.agg(F.count("*").alias("_c")))).where("_c = 0").drop("_c")  # one row
    return common.unionByName(some.orderBy(F.col("n").desc(), "theme").limit(n)).orderBy(F.col("n").desc(), "theme")


def unique_themes(tops: DataFrame, n: int = 3, otherwise: int = 2) -> DataFrame:
    """Of tops (entity_id, theme, place): each entity's first n themes that no other has, else its first ones."""
    marked = tops.join(tops.groupBy("theme").agg(F.count_distinct("entity_id").alias("_of")), "theme")
    own = top_per_group(marked.where("_of = 1"), ["entity_id"], [F.col("place"), F.col("theme")], n)
    rest = marked.join(own.select("entity_id").distinct(), "entity_id", "left_anti")
    return own.unionByName(top_per_group(rest, ["entity_id"], [F.col("place"), F.col("theme")], otherwise)).select("entity_id", "theme", "place")


def coverage(chunks: DataFrame, text: str) -> DataFrame:
    n = F.count("*")
    return chunks.agg(F.when(n == 0, 0.1).otherwise(F.least(F.lit(1.0), 0.4 + 0.6 * F.count_if(T.filled(F.col(text))) / n)).alias("coverage"))


def grounding(chunks: DataFrame, text: str, answer: str) -> DataFrame:
    """Mean share of the answer's words that a chunk has, within 0.2 and 1; 0.15 without chunks, 0.7 without words."""
    words = F.array_distinct(T.tokens(F.lit(answer)))
    share = F.size(F.array_intersect(words, T.tokens(F.col(text)))) / F.size(words)
    mean = F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.avg(share)))
    return chunks.agg(F.when(F.count("*") == 0, 0.15).when(F.first(F.size(words), True) == 0, 0.7).otherwise(mean).alias("grounding"))


def confidence(chunks: DataFrame, text: str, answer: str) -> DataFrame:
    """One row: the mean of coverage and grounding within 0 and 1, to two digits, and whether there is any chunk."""
    both = coverage(chunks, text).crossJoin(grounding(chunks, text, answer)).crossJoin(chunks.agg(F.count("*").alias("n")))  # one row each
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("coverage") + F.col("grounding")) / 2))
    return both.select(T.round_exact(mean, 2).alias("confidence"), (F.col("n") > 0).alias("passed"), F.when(F.col("n") > 0, "ok").otherwise("no_relevant_chunks").alias("notes"))


def export_statistics(messages: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Conditional counts of one pass."""
    return messages.agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in kinds.items()))


def evaluation(scores: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, precision and recall of 0/1 columns."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    hit = F.count_if(t & g)
    return scores.agg((F.count_if(t == g) / F.count("*")).alias("accuracy"), (hit / F.nullif(F.count_if(g), F.lit(0))).alias("precision"), (hit / F.nullif(F.count_if(t), F.lit(0))).alias("recall"))

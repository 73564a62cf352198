"""Text, date, JSON and URL functions as Columns; Python runs only where no built-in function has the semantics."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Signs that don't count as a review.
NOT_A_TEXT = ("-", ".", "\U0001f44d")
#: Fixed values of the promotion heuristic.
PROMO_PHRASES = (
    "приглашаем принять участие", "приглашаем вас", "регистрац", "промокод", "скидк", "рассылк", "подписывайтесь на канал",
    "переходите по ссылке", "успейте купить", "только сегодня", "бесплатный вебинар", "запись вебинара", "купить курс", "оплатить",
)
MEETING = r"zoom\.us|идентификатор конференции|код доступа:\s*\d"
LINK = r"https?://\S+|t\.me/\S+"
EVENT = r"мозговой штурм|вебинар|конференц|трансляц|прямой эфир|не пропустите"
#: City names by the first label of a host.
CITY_NAMES = {
    "irk": "Иркутск", "msk": "Москва", "spb": "Санкт-Петербург", "ekb": "Екатеринбург", "nsk": "Новосибирск", "kzn": "Казань",
    "smr": "Самара", "rnd": "Ростов-на-Дону", "vrn": "Воронеж", "krd": "Краснодар", "ufa": "Уфа", "chl": "Челябинск", "perm": "Пермь",
    "vlg": "Волгоград", "krsk": "Красноярск", "tula": "Тула",
}


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|(?U)\s+$", "")


def filled(text: Column) -> Column:
    """Whether text has more than white space."""
    return F.length(strip(F.coalesce(text, F.lit("")))) > 0


def or_null(text: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def summary(text: Column, n: int = 220) -> Column:
    return strip(F.substring(text, 1, n))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def for_matching(text: Column) -> Column:
    """Lower case, ё as е, runs of white space as one space."""
    return F.regexp_replace(F.translate(F.lower(strip(F.coalesce(text, F.lit("")))), "ё", "е"), r"(?U)\s+", " ")


def is_review_text(text: Column) -> Column:
    bare = strip(F.coalesce(text, F.lit("")))
    return (F.length(bare) >= 5) & ~bare.isin(*NOT_A_TEXT)


def mentions(hay: Column, needle: str) -> Column:
    """Whether hay holds needle; one in ASCII also if hay holds it without its spaces. A blank needle is nowhere."""
    own = " ".join(needle.strip().lower().replace("ё", "е").split())
    if not own:
        return F.lit(False)
    text = for_matching(hay)
    found = text.contains(own)
    return found | F.regexp_replace(text, " ", "").contains(own.replace(" ", "")) if own.isascii() else found


def contains_any(columns: list[Column], query: str) -> Column:
    """ILIKE over several columns; % and _ in the query stay wildcards."""
    return reduce(lambda a, b: a | b, (F.coalesce(c.ilike(f"%{query}%"), F.lit(False)) for c in columns))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words of over two letters that text has; 0 without any on either side."""
    asked = F.array_distinct(F.filter(tokens(query), lambda t: F.length(t) > 2))
    n = F.size(asked)
    return F.when(n > 0, F.size(F.array_intersect(asked, tokens(text))) / n).otherwise(0.0)


def tags(values: Column) -> Column:
    """A list as text: its non-blank values, comma-separated."""
    return F.array_join(F.filter(F.transform(values, strip), lambda x: F.length(x) > 0), ", ")


def split_topics(text: Column, least: int = 1, pattern: str = "[,;]") -> Column:
    """Distinct occurrences stay: each topic in lower case, stripped, of least letters."""
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.lower(strip(x))), lambda x: F.length(x) >= least)


def review_time(text: Column) -> Column:
    """The first 19 characters as a time, else the first 10 as a date, else null."""
    head = F.substring(text, 1, 19)
    return F.coalesce(F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(head, F.lit("yyyy-MM-dd")))


def message_time(date: Column, unix: Column) -> Column:
    """An ISO date, else seconds since 1970, else null."""
    return F.coalesce(F.try_to_timestamp(date), F.timestamp_seconds(unix.try_cast("bigint")))


def message_year(date: Column, unix: Column) -> Column:
    return F.coalesce(F.left(date, F.lit(4)).try_cast("int"), F.year(F.timestamp_seconds(unix.try_cast("bigint"))))


def positive_id(value: Column) -> Column:
    """A whole number over 0, else null."""
    number = value.try_cast("bigint")
    return F.when(number > 0, number)


def first_rating(value: Column, clinic: Column) -> Column:
    """The first that is a number."""
    return F.coalesce(value.try_cast("double"), clinic.try_cast("double"))


def first_nonzero_rating(value: Column, clinic: Column) -> Column:
    """The first that is a number other than 0, else the second."""
    return F.coalesce(F.nullif(value.try_cast("double"), F.lit(0.0)), clinic.try_cast("double"))


def synthetic_id(alias: Column, created: Column, text: Column, name: Column) -> Column:
    """A positive id from what a review without one has."""
    none = lambda c: F.coalesce(c, F.lit(""))
    joined = F.concat_ws("|", none(alias), none(created), F.substring(none(text), 1, 300), none(name))
    number = F.crc32(F.encode(joined, "UTF-8")).bitwiseAND(0x7FFFFFFF)
    return F.when(number == 0, 1).otherwise(number)


def export_key(chat_id: Column, name: Column) -> Column:
    slug = F.substring(F.regexp_replace(strip(name), r"[^\p{L}\p{N}_-]+", "_"), 1, 120)
    return F.when(chat_id.isNotNull(), chat_id.cast("string")).when(filled(name), F.concat(F.lit("name:"), slug)).otherwise("unknown_chat")


def promotion(text: Column) -> Column:
    """struct<spam, reason>: what is plainly an advertisement, and why."""
    bare = strip(F.coalesce(text, F.lit("")))
    n = F.length(bare)
    has = lambda pattern: bare.rlike(f"(?iu){pattern}")
    phrase, meeting, link, event = has("|".join(PROMO_PHRASES)), has(MEETING), has(LINK), has(EVENT)
    signs = [phrase, event & (link | meeting), meeting & (n < 1200), (n < 350) & link & event]
    hits = reduce(lambda a, b: a + b, (s.cast("int") for s in signs))
    reason = F.when(n == 0, "empty").when(n < 12, "").when(hits >= 2, "promo_event_or_links").when((hits == 1) & phrase & (n < 500), "short_promo_cta").otherwise("")
    return F.struct((reason != "").alias("spam"), reason.alias("reason"))


def sentiment(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("pos") | low.contains("позит"), "positive").when(low.contains("neg") | low.contains("негат"), "negative").otherwise("neutral")


def links(html: Column, pattern: str = r"href=[\"']([^\"']+)[\"']") -> Column:
    """Distinct link targets in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def service_links(html: Column) -> tuple[Column, Column]:
    """Links to services (two levels) and to their hubs (one level, sorted)."""
    path = lambda depth: rf"[\"'](?:https?://[^/\"']+)?(/service{'/[a-z0-9_-]+' * depth})/?[\"']"
    return links(html, path(2)), F.array_sort(links(html, path(1)))


def page_kind(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(path.rlike("^/?$"), "main").when(path.rlike("^/service(/|$)"), "service").when(path.rlike("^/clinic(/|$)"), "clinic").when(path.rlike("^/doctor(/|$)"), "doctor").otherwise("unknown")


def first_label(url: Column) -> Column:
    return F.lower(F.split_part(F.try_parse_url(url, F.lit("HOST")), F.lit("."), F.lit(1)))


def city_name(state_name: Column, url: Column) -> Column:
    """What a page says, else by its host's first label."""
    names = F.create_map(*(F.lit(x) for pair in CITY_NAMES.items() for x in pair))
    return F.coalesce(or_null(state_name), names[first_label(url)])


def join_url(base: str, link: Column) -> Column:
    return F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).otherwise(F.concat(F.lit(base.rstrip("/")), F.when(link.startswith("/"), link).otherwise(F.concat(F.lit("/"), link))))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities as the characters they name: a table that Spark doesn't have."""
    import html

    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def unescape_closed(text: pd.Series) -> pd.Series:
    """unescape for references that end in a semicolon alone: one that is cut off, or a bare &copy in an address, stays as it is."""
    import html.entities
    import re

    closed = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")
    named = lambda m: html.entities.html5.get(f"{m[1]};", m[0]) if m[1] else html.unescape(m[0])
    return text.map(lambda t: closed.sub(named, t), na_action="ignore")


def plain_text(html: Column, closed: bool = False) -> Column:
    """Tags as spaces, entities (those that end in a semicolon, if closed) as characters, white space collapsed."""
    bare = F.regexp_replace(html, "<[^>]+>", " ")
    return strip(F.regexp_replace(unescape_closed(bare) if closed else unescape(bare), r"(?U)\s+", " "))


def page_state(html: Column) -> Column:
    """The JSON text inside the page's data script, null without one."""
    return F.nullif(F.regexp_extract(html, r"(?s)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1), F.lit(""))


def attribute_json(html: Column, name: str) -> Column:
    """The JSON text in an attribute, entities unescaped."""
    pattern = rf"(?s)[\s:]{name}=(?:\"([^\"]*)\"|'([^']*)')"
    return F.nullif(unescape(F.concat(F.regexp_extract(html, pattern, 1), F.regexp_extract(html, pattern, 2))), F.lit(""))


def _balanced(text: str | None, open_: str, close: str) -> str | None:
    """The first balanced JSON value that begins with open_, else up to the last close, if that parses."""
    if text is None or (start := text.find(open_)) < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(text[start:])
    except ValueError:
        try:
            value = json.loads(text[start : text.rfind(close) + 1])
        except ValueError:
            return None
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def lenient_object(text: pd.Series) -> pd.Series:
    """The JSON object in a text that may have a fence or prose around it."""
    return text.map(lambda t: _balanced(t, "{", "}"), na_action="ignore")


@F.pandas_udf(StringType())
def lenient_array(text: pd.Series) -> pd.Series:
    """The JSON array in a text, else the rows or replies of its object."""

    def read(t: str) -> str | None:
        if (found := _balanced(t, "[", "]")) and not t.lstrip("` \njson").startswith("{"):
            return found
        value = json.loads(_balanced(t, "{", "}") or "{}")
        rows = next((value[k] for k in ("rows", "replies") if isinstance(value.get(k), list)), None)
        return found if rows is None else json.dumps(rows, ensure_ascii=False)

    return text.map(read, na_action="ignore")


def salvaged(text: Column) -> Column:
    """struct<rating, sentiment, summary, tags> from what looks like keys of an analysis in text that is no JSON; null without any."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    rating = found(r'"rating"\s*:\s*(\d+)').try_cast("int")
    sentiment = found(r'"sentiment"\s*:\s*"([^"]*)"')
    summary = F.coalesce(found(r'(?s)"summary"\s*:\s*"((?:[^"\\]|\\.)*)"'), found(r'(?s)"summary"\s*:\s*"([^"]{1,800})'))
    inner = found(r'(?s)"tags"\s*:\s*\[(.*?)\]')
    listed = F.regexp_extract_all(inner, F.lit('"([^"]*)"'), F.lit(1))
    tags_ = F.when(inner.isNotNull(), F.when(F.size(listed) > 0, listed).otherwise(F.array(strip(inner))))
    some = rating.isNotNull() | sentiment.isNotNull() | summary.isNotNull() | tags_.isNotNull()
    return F.when(some, F.struct(rating.alias("rating"), sentiment.alias("sentiment"), strip(F.replace(summary, F.lit("\\n"), F.lit("\n"))).alias("summary"), tags_.alias("tags")))


def payload(*columns: str | Column) -> Column:
    """Columns as a JSON object: times in ISO form, nulls kept."""
    return F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"})


def round_exact(value: Column, places: int) -> Column:
    """value to 0 to 15 places by its exact binary value, ties to even. Spark's round and bround go by the shortest decimal that
    reads back as the value, so that 2.675, which lies below its decimal, becomes 2.68; casts to decimal do the same.

    A value is m / 2^s with whole m and s; the nearest whole number k to value * 10^places is found from the approximate product, and
    corrected by 2 * (m * 10^places - k * 2^s), which decimals of 38 digits hold. k / 10^places is then the nearest double.
    """
    whole = lambda c: c.cast("bigint").cast("decimal(38,0)")  # a double's own cast goes by its shortest decimal
    power, size = 10**places, F.abs(value)
    s = 53 - F.floor(F.log2(size)).cast("int")
    about = F.floor(size * float(power) + 0.5)
    unit = whole(F.pow(F.lit(2.0), F.least(s, F.lit(62)))) * whole(F.pow(F.lit(2.0), F.greatest(s - 62, F.lit(0))))
    twice = (whole(size * F.pow(F.lit(2.0), s)) * whole(F.lit(power)) - whole(about) * unit) * whole(F.lit(2))
    odd = about % 2 == 1
    step = F.when((twice > unit) | ((twice == unit) & odd), 1).when((twice < -unit) | ((twice == -unit) & odd), -1).otherwise(0)
    rounded = F.when(value < 0, -1.0).otherwise(1.0) * ((about + step).cast("double") / float(power))
    small, fine = size * float(power) < 0.25, ~F.isnan(value) & (size * float(power) < float(2**53)) & (size < float(2**52))
    return F.when(small & ~F.isnan(value), F.when(value < 0, -0.0).otherwise(value * 0.0)).when(fine, rounded).otherwise(value)


def likeness(wanted: str):
    """A function of a name column: the share of characters in blocks that match, found longest first, in name and wanted."""

    @F.pandas_udf(DoubleType())
    def ratio(names: pd.Series) -> pd.Series:
        import difflib

        matcher = difflib.SequenceMatcher(None, "", wanted)  # what it knows of wanted serves all names
        out = []
        for name in names:
            matcher.set_seq1(name or "")
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return ratio

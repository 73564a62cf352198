"""Tables from saved pages: services, clinics, doctors, their reviews, link lists, and where a review feed goes on."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from opinara.functions import text as T
from opinara.operators import tables as S

_CLINIC = "id bigint, name string, alias string, fullAddress string, address string"
_DOCTOR = "id: bigint, name: string, url: string, image: string, price: double, specialPrice: double, specialPricePercent: double, totalRating: double, reviewsCount: int, station: string, address: string"
_SERVICE = (
    "serviceId bigint, serviceInfo struct<id: bigint, name: string, parentId: bigint, parentServiceName: string, rootId: bigint, avgPrice: double, description: string, synonyms: array<string>>, "
    "breadcrumbs array<struct<name: string, url: string>>, directions array<struct<id: bigint, name: string, title: string>>, reviews array<string>, clinics array<string>, "
    f"additionalClinicsWithoutFilters array<string>, additionalParentLevelClinics array<string>, bestDoctors array<struct<{_DOCTOR}>>, "
    "reviewsCount int, reviewsOffset int, reviewsSort int, reviewsFilter int"
)
_STATE = "$.props.pageProps.preloadedState"
SHOP_REVIEW = ArrayType(StructType().add("reviewer", "string").add("rating", "integer").add("review_date", "string").add("comment", "string"))
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def page_source(html: Column) -> Column:
    """The page that a saved source view shows; other pages as they are. Null stays null."""
    cells = F.regexp_extract_all(html, F.lit(r'(?s)<td[^>]*class="line-content"[^>]*>(.*?)</td>'), F.lit(1))
    shown = T.unescape(F.regexp_replace(F.array_join(cells, ""), r"</?span[^>]*>", ""))
    return F.when(F.size(cells) > 0, shown).otherwise(html)


def page_state(html: Column, part: str) -> Column:
    """The JSON text of a part of the state within a page, null without it."""
    return F.get_json_object(T.page_state(html), f"{_STATE}.{part}")


def _city(address: Column) -> Column:
    return F.coalesce(T.or_null(F.get_json_object(address, "$.city")), F.when(~F.coalesce(address, F.lit("")).startswith("{"), T.or_null(address)))


def _clinic(card: Column) -> Column:
    """A card's clinic, which may be the card itself."""
    return F.from_json(F.coalesce(F.get_json_object(card, "$.clinic"), card), _CLINIC)


def _in_city(cards: Column, city: Column, else_: bool) -> Column:
    return F.transform(cards, lambda c: F.struct(_clinic(c)["alias"].alias("alias"), F.coalesce(F.lower(_city(F.coalesce(_clinic(c)["fullAddress"], _clinic(c)["address"]))) == F.lower(city), F.lit(else_)).alias("own")))


def service_pages(pages: DataFrame) -> DataFrame:
    """Of pages (page_url, html) a row each: ok, service, breadcrumbs, directions, clinics, doctors, reviews of the page's city.

    Clinics and reviews of other cities drop out; a review's city is its clinic's on the page, else its own, else it stays.
    A page without service state has ok false and nulls.
    """
    empty = F.array().cast("array<string>")
    read = pages.select("page_url", page_source(F.col("html")).alias("html"))
    read = read.select("page_url", F.from_json(page_state(F.col("html"), "servicePage"), _SERVICE).alias("s"), T.city_name(page_state(F.col("html"), "city.cities[0].name"), F.col("page_url")).alias("target_city_name"))
    blocks = [("clinics", True), ("additionalClinicsWithoutFilters", False), ("additionalParentLevelClinics", False)]
    read = read.withColumn("known", F.concat(*(_in_city(F.coalesce(f"s.{b}", empty), F.col("target_city_name"), d) for b, d in blocks)))
    own_alias = F.transform(F.filter("known", lambda k: k["own"]), lambda k: k["alias"])
    other_alias = F.transform(F.filter("known", lambda k: ~k["own"]), lambda k: k["alias"])

    def stays(review: Column) -> Column:
        alias, city = F.get_json_object(review, "$.clinic.alias"), _city(F.get_json_object(review, "$.clinic.fullAddress"))
        by_alias = F.when(F.array_contains(own_alias, alias), True).when(F.array_contains(other_alias, alias), False)
        return F.coalesce(by_alias, F.lower(city) == F.lower(F.col("target_city_name")), F.lit(True))

    def card(row: Column) -> Column:
        c, service = _clinic(row), F.from_json(F.get_json_object(row, "$.service"), "id bigint, name string")
        address = F.coalesce(c["fullAddress"], c["address"])
        return F.struct(
            c["id"].alias("clinic_id"), c["name"].alias("clinic_name"), c["alias"].alias("clinic_alias"), address.alias("full_address"), _city(address).alias("city"),
            F.get_json_object(row, "$.inPrice").try_cast("double").alias("in_price"), F.get_json_object(row, "$.reviewsCount").try_cast("int").alias("reviews_count"),
            F.get_json_object(row, "$.reviewsUrl").alias("reviews_url"), service["name"].alias("service_card_name"), service["id"].alias("service_card_id"),
        )

    cards = F.filter(F.transform(F.coalesce("s.clinics", empty), card), lambda c: F.coalesce(F.lower(c["city"]) == F.lower(F.col("target_city_name")), F.lit(True)))
    raw = F.coalesce("s.reviews", empty)
    out = read.select(
        "page_url", F.col("s").isNotNull().alias("ok"), "target_city_name", T.first_label(F.col("page_url")).alias("city_slug"), F.col("s.serviceInfo").alias("info"), "s.breadcrumbs", "s.directions",
        F.when(F.col("s").isNotNull(), cards).alias("clinics"), F.col("s.bestDoctors").alias("raw_doctors"), F.filter(raw, stays).alias("reviews"), F.size(F.filter(raw, lambda r: ~stays(r))).alias("reviews_dropped_other_city"),
        F.col("s.reviewsCount").alias("reviews_count_total"),
    )
    return out.withColumn("description_plain", T.plain_text(F.col("info.description")))


def best_doctors(services: DataFrame) -> DataFrame:
    """A row for each doctor's card of service_pages, with its service and whole address."""
    d = services.select("page_url", "info", F.explode("raw_doctors").alias("d")).where("d is not null")
    url = F.regexp_extract("page_url", "^([a-z]+://[^/?#]*)", 1)
    path = F.coalesce("d.url", F.lit(""))
    return d.select(
        F.col("d.id").alias("doctor_id"), "d.name", F.when(path.rlike("^[a-z]+://") | (path == ""), path).otherwise(F.concat(url, F.lit("/"), F.ltrim(path, F.lit("/")))).alias("profile_url"), path.alias("profile_path"),
        F.col("d.image").alias("image_url"), "d.price", F.col("d.specialPrice").alias("special_price"), F.col("d.specialPricePercent").alias("special_price_percent"), F.col("d.totalRating").alias("total_rating"),
        F.col("d.reviewsCount").alias("reviews_count"), "d.station", "d.address", F.col("info.id").alias("service_id"), F.coalesce("info.name", F.lit("")).alias("service_name"),
        F.coalesce("info.parentServiceName", F.lit("")).alias("parent_service_name"),
    )


def doctor_pages(pages: DataFrame) -> DataFrame:
    """Of pages (page_url, html) a row each: ok, doctor_alias, doctor, reviews (array of structs), reviews_count_total."""
    html = page_source(F.col("html"))
    either = lambda *paths: F.coalesce(*(F.get_json_object("j", f"$.{p}") for p in paths))
    inner = lambda *names: either(*(f"{at}{n}" for n in names for at in ("doctorInfo.", "doctor.", "")))
    read = pages.select("page_url", T.page_state(html).isNotNull().alias("ok"), F.coalesce(page_state(html, "doctorPage"), page_state(html, "doctor"), F.lit("{}")).alias("j"))
    doctor = F.struct(
        inner("id").try_cast("bigint").alias("id"), F.coalesce(inner("name", "fullName"), F.lit("")).alias("name"), inner("speciality", "specialityName").alias("speciality"), inner("experience").alias("experience"),
        inner("image", "photo").alias("image_url"), inner("totalRating", "rating").try_cast("double").alias("total_rating"), inner("reviewsCount").try_cast("int").alias("reviews_count"), inner("clinicName").alias("clinic_name"),
    )
    read = read.select("page_url", "ok", F.nullif(F.regexp_extract("page_url", "://[^/?#]*/doctor/([^?#]*?)/?(?:[?#]|$)", 1), F.lit("")).alias("doctor_alias"), doctor.alias("doctor"), inner("description", "about").alias("about"), either("reviews", "doctorInfo.reviews", "doctor.reviews").alias("r"), either("reviewsCount").try_cast("int").alias("n"))

    def review(x: Column) -> Column:
        at = lambda p: F.get_json_object(x, f"$.{p}")
        return F.struct(
            at("id").try_cast("bigint").alias("review_id"), at("created").alias("created"), F.coalesce(T.strip(at("text")), F.lit("")).alias("text"), F.coalesce(T.strip(at("answer")), F.lit("")).alias("answer"),
            F.coalesce(at("rating.value"), at("rating")).try_cast("double").alias("rating_value"), at("rating.label").alias("rating_label"), at("publicName").alias("patient_public_name"), at("clinic.name").alias("clinic_name"),
            at("service.name").alias("service_name"), F.col("doctor.id").alias("doctor_id"), F.col("doctor.name").alias("doctor_name"), F.col("page_url").alias("source_page_url"),
        )

    reviews = F.transform(F.coalesce(F.from_json("r", "array<string>"), F.array().cast("array<string>")), review)
    kept = read.withColumn("reviews", reviews).withColumn("reviews_count_total", F.coalesce(F.nullif("n", F.lit(0)), F.size("reviews")))
    return kept.withColumn("description_plain", T.plain_text(F.col("about"))).drop("r", "n", "about")


def clinic_pages(pages: DataFrame) -> DataFrame:
    """Of pages (page_url, html) a row each: clinic_alias, clinic, clinics_cards, service_catalog, clinic_id, review totals."""
    read = pages.select("page_url", page_source(F.col("html")).alias("html"))
    cards = F.coalesce(F.from_json(T.attribute_json(F.col("html"), "clinics"), "array<struct<id: bigint, name: string, alias: string, rating: double, fullAddress: string>>"), F.array().cast("array<struct<id: bigint, name: string, alias: string, rating: double, fullAddress: string>>"))
    med = F.from_json(T.attribute_json(F.col("html"), "med-services"), "map<string, struct<name: string, specialityId: bigint, title: string, prices: array<struct<id: bigint, name: string, price: double, specialPrice: double, finalPrice: double, description: string>>>>")
    rows = lambda e: F.transform(F.coalesce(e["value"]["prices"], F.array()), lambda p: F.struct(e["key"].alias("direction_key"), e["value"]["name"].alias("direction_name"), e["value"]["specialityId"].alias("speciality_id"), e["value"]["title"].alias("direction_page_title"), p["id"].alias("service_id"), p["name"].alias("service_name"), p["price"].alias("price"), p["specialPrice"].alias("special_price"), p["finalPrice"].alias("final_price"), p["description"].alias("description")))
    number = lambda *patterns: F.coalesce(*(F.regexp_extract("html", p, 1).try_cast("int") for p in patterns))
    out = read.select(
        "page_url", T.first_label(F.col("page_url")).alias("city_slug"), cards.alias("clinics_cards"), F.flatten(F.transform(F.map_entries(F.coalesce(med, F.create_map().cast(_MED))), rows)).alias("service_catalog"),
        number(r'(?i)name="clinicId"[^>]*value="(\d+)"', r'(?is)<adaptive-reviews-container\b[^>]*:id="(\d+)"').alias("clinic_id"),
        number(r'(?is)<adaptive-reviews-container\b[^>]*:total-count="(\d+)"', r':total-reviews-count="(\d+)"').alias("reviews_count_total"),
        F.regexp_count("html", F.lit(r'itemtype="http://schema.org/Review"')).alias("reviews_loaded_count"), F.nullif(F.regexp_extract("page_url", "://[^/?#]*/clinic/([^/?#]+)", 1), F.lit("")).alias("alias"),
    )
    first = F.try_element_at("clinics_cards", F.lit(1))
    return out.select("page_url", "city_slug", F.coalesce("alias", first["alias"]).alias("clinic_alias"), first.alias("clinic"), "clinics_cards", "service_catalog", "clinic_id", "reviews_count_total", "reviews_loaded_count", F.coalesce(F.col("reviews_loaded_count") < F.col("reviews_count_total"), F.lit(False)).alias("reviews_incomplete"))


_MED = "map<string, struct<name: string, specialityId: bigint, title: string, prices: array<struct<id: bigint, name: string, price: double, specialPrice: double, finalPrice: double, description: string>>>>"


def parsed(pages: DataFrame) -> dict[str, DataFrame]:
    """Of pages (page_url, html) those of each kind by their own reader: service, doctor, clinic; main pages with their links
    to services and hubs; unknown ones as they are."""
    kind = T.page_kind(F.col("page_url"))
    of = lambda name: pages.where(kind == name)
    services, hubs = T.service_links(F.col("html"))
    return {
        "service": service_pages(of("service")),
        "doctor": doctor_pages(of("doctor")),
        "clinic": clinic_pages(of("clinic")),
        "main": of("main").select("page_url", services.alias("service_urls"), hubs.alias("hub_urls")),
        "unknown": of("unknown").select("page_url"),
    }


def merged_reviews(main: DataFrame, review_pages: DataFrame) -> DataFrame:
    """Reviews (review_id, text, created, pos, ...) of a page and of its review pages: of equal ids, or else equal text and day, the
    last, at the place of the first."""
    both = main.withColumn("_late", F.lit(0)).unionByName(review_pages.withColumn("_late", F.lit(1)))
    both = both.withColumn("pos", F.col("_late") * F.lit(1 << 40) + F.col("pos")).drop("_late")
    key = F.coalesce(F.col("review_id").cast("string"), F.concat_ws("|", "text", "created"))
    return S.merge_keep_last(both, key, "pos")


def review_feed(pages: DataFrame, path: str) -> DataFrame:
    """Where the review feed of a service's page goes on: service_id, offset, filter, sort, total and the next request's url.

    path is that of the feed below the site's API; pages without an API or a service id have no row.
    """
    html = page_source(F.col("html"))
    read = pages.select("page_url", page_state(html, "defaultLayout.apiBaseUrl").alias("api"), F.from_json(page_state(html, "servicePage"), _SERVICE).alias("s"))
    rows = read.select(
        "page_url", F.rtrim("api", F.lit("/")).alias("api"), F.coalesce("s.serviceId", "s.serviceInfo.id").alias("service_id"), F.greatest(F.lit(0), F.coalesce("s.reviewsOffset", F.size(F.coalesce("s.reviews", F.array())))).alias("offset"),
        F.coalesce("s.reviewsFilter", F.lit(0)).alias("filter"), F.coalesce("s.reviewsSort", F.lit(0)).alias("sort"), F.col("s.reviewsCount").alias("total"),
    ).where("api <> '' and service_id is not null")
    return rows.withColumn("url", F.format_string(f"%s{path}?serviceId=%d&offset=%d&filter=%d&sort=%d", "api", "service_id", "offset", "filter", "sort"))


def discovered_services(main: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Service links of a site's main page and hubs (html): each once as (url), and a row of counts."""
    each = lambda df, source: df.select(F.lit(source).alias("source"), F.explode(T.service_links(F.col("html"))[0]).alias("url"))
    found = each(main, "main").unionByName(each(hubs, "hubs"))
    stats = found.agg(F.count_if(F.col("source") == "main").alias("from_main"), F.count_if(F.col("source") == "hubs").alias("from_hubs"), F.countDistinct("url").alias("total_unique"))
    return found.select("url").distinct(), stats


class _Tree(HTMLParser):
    """Calls begin and end with each element's path of (tag, classes, attributes); elements without an end close with their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, set[str], dict]] = []

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        self.path.append((tag, set(own.get("class", "").split()), own))
        self.begin()
        if tag in VOID:
            self.end(self.path.pop())

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.path):
            while True:
                done = self.path.pop()
                self.end(done)
                if done[0] == tag:
                    return

    def within(self, tag: str, name: str) -> bool:
        return any(t == tag and (not name or name in c) for t, c, _ in self.path[:-1])

    def begin(self) -> None: ...
    def end(self, done) -> None: ...


def site_links(html: Column, base: str, inside: list[tuple[str, str]], classes: tuple[str, ...] = (), start: str = "") -> Column:
    """Distinct whole links of one of the classes that stand within all of inside (tag, class), in order; start limits their text."""

    class Links(_Tree):
        def begin(self):
            tag, own, attrs = self.path[-1]
            link = attrs.get("href", "").strip()
            if tag == "a" and link and link.startswith(start) and (not classes or own & set(classes)) and all(self.within(*i) for i in inside):
                self.found[urljoin(base, link)] = None

    @F.pandas_udf(ArrayType(StringType()))
    def links(pages: pd.Series) -> pd.Series:
        def one(page):
            tree = Links()
            tree.found = {}
            tree.feed(page or "")
            return list(tree.found)

        return pages.map(one)

    return links(html)


def category_links(html: Column, base: str, start: str) -> Column:
    return site_links(html, base, [("li", "")], start=start)


def product_links(html: Column, base: str) -> Column:
    return site_links(html, base, [("div", "product-list"), ("div", "item")], ("product-name",))


def pager_links(html: Column, base: str) -> Column:
    return site_links(html, base, [("div", "pager")], ("pager-item", "next", "last"))


@F.pandas_udf(SHOP_REVIEW)
def shop_reviews(html: pd.Series) -> pd.Series:
    """Reviews in a shop's comment list; without an author Аноним, without a date Не найдено, without stars 0. No list: none."""
    parts = {("p", "feedback__header"): "reviewer", ("div", "feedback__date"): "review_date"}

    class Comments(_Tree):
        rows: list[dict]

        def begin(self):
            tag, own, _ = self.path[-1]
            if tag == "li" and "comments__item" in own and self.within("ul", "comments__list"):
                self.rows.append({"said": []})
            elif self.rows and self.within("li", "comments__item"):
                row = self.rows[-1]
                for (t, c), field in parts.items():
                    if tag == t and c in own:
                        row.setdefault(field, [])
                if tag == "span" and "feedback__rating" in own:
                    row.setdefault("rating", next((int(c[4:]) for c in own if c.startswith("star") and c[4:].isdigit()), 0))
                if tag == "span" and "feedback__text--item" in own:
                    row["said"].append(([], []))

        def handle_data(self, data):
            if not self.rows or not any(t == "li" and "comments__item" in c for t, c, _ in self.path):
                return
            row, at = self.rows[-1], {(t, c) for t, own, _ in self.path for c in own}
            for key, field in parts.items():
                if key in at:
                    row[field].append(data.strip())
            if ("span", "feedback__text--item") in at:
                row["said"][-1][("span", "feedback__text--item-bold") in at].append(data.strip())

    def one(page):
        tree = Comments()
        tree.rows = []
        tree.feed(page or "")
        out = []
        for row in tree.rows:
            said = ["".join(text) for text, label in row["said"] if not any(label) or "Комментарий" in "".join(label)]
            out.append({"reviewer": "".join(row["reviewer"]) if "reviewer" in row else "Аноним", "rating": row.get("rating", 0), "review_date": "".join(row["review_date"]) if "review_date" in row else "Не найдено", "comment": said[-1] if said else ""})
        return out

    return html.map(one)

"""Readers: tables, crawl files, chat exports, pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.sources import split
from opinara.storage import exists

DOCTOR = "doctor_id bigint, name string, speciality string, address string, total_rating double, reviews_count int, price double, service_id bigint, service_name string, parent_service_name string, profile_url string, profile_path string"
REVIEW = (
    "review_id bigint, text string, answer string, rating_value double, rating_clinic double, rating_label string, patient_public_name string, "
    "clinic_name string, clinic_alias string, clinic_city string, doctor_id bigint, doctor_name string, service_id bigint, service_name string, "
    "parent_service_name string, category_direction_title string, created string, source_page_url string"
)
CRAWL = (
    "ok boolean, base_url string, city_slug string, target_city_name string, "
    f"services array<struct<ok: boolean, page_url: string, service: struct<id: bigint, name: string, parent_service_name: string, avg_price: double, description_plain: string, synonyms: array<string>>, breadcrumbs: array<struct<name: string, url: string>>, clinics: array<struct<clinic_id: bigint, clinic_name: string, clinic_alias: string, city: string>>, doctors: array<struct<{DOCTOR}>>, reviews: array<struct<{REVIEW}>>, reviews_count_total: int>>, "
    f"clinics array<struct<ok: boolean, page_url: string, clinic_alias: string, clinic: struct<id: bigint, name: string, rating: double, full_address: string>, reviews: array<struct<{REVIEW}>>>>, "
    f"doctor_profiles array<struct<ok: boolean, page_url: string, doctor_alias: string, doctor: struct<id: bigint, name: string, speciality: string, total_rating: double, reviews_count: int>, reviews: array<struct<{REVIEW}>>>>, "
    f"reviews array<struct<{REVIEW}>>"
)
MESSAGE = "type string, id bigint, date string, date_unixtime string, `from` string, from_id string, actor string, reply_to_message_id bigint, text variant, text_entities array<struct<text: string>>, caption variant, poll struct<question: string, answers: array<struct<text: string>>>, photo string, file string, media_type string, sticker_emoji string"
EXPORT = f"id string, name string, type string, messages array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in MESSAGE.replace('struct<question: string, answers: array<struct<text: string>>>', 'POLL').split(', '))}>>".replace("POLL", "struct<question: string, answers: array<struct<text: string>>>")


CHUNK = (
    "kind string, ref string, title string, body string, service_external_id bigint, service_name string, parent_service_name string, clinic_alias string, "
    "clinic_name string, doctor_external_id bigint, doctor_name string, rating_value double, source_page_url string, tags string"
)
WIDEST = {"title": 512, "body": 4000, "tags": 256, "source_page_url": 512}


def columns_of(df: DataFrame) -> Callable[[str], Column]:
    """Columns by name, null where df lacks one."""
    return lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")


def as_chunks(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The columns of CHUNK: those in made, else the ones of df; names and links are blank rather than null."""
    c, out = columns_of(df), []
    for name, kind in (part.split(" ") for part in CHUNK.split(", ")):
        value = made.get(name, c(name)).try_cast(kind)
        value = F.coalesce(T.strip(value) if name == "body" else value, F.lit("")) if kind == "string" else value
        out.append((F.substring(value, 1, WIDEST[name]) if name in WIDEST else value).alias(name))
    return df.select(*out)


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in names]


def crawl(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A crawl file, which is one document; with lines a document in each line, of which tasks share a file's. Unreadable ones
    give a row of nulls. document tells their order: by file, and in it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.schema(CRAWL).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path).select("*", place.alias("document"))


def crawl_checkpoint(spark: SparkSession, path: str, lines: bool = False) -> DataFrame | None:
    """A crawl's saved state; None where there is none or it can't be read."""
    if not exists(spark, path):
        return None
    doc = crawl(spark, path, lines)
    return None if doc.where("base_url is not null or services is not null or reviews is not null").isEmpty() else doc


def crawl_reviews(doc: DataFrame) -> DataFrame:
    """All reviews of a crawl, from services, clinics, doctors and its own list, with src_order and pos: the place of the document,
    of the page in its list and of the review in the page."""
    flat = None
    place = F.struct("document", F.col("a").alias("page"), F.col("b").alias("review")).alias("pos")
    for order, source in enumerate(("services", "clinics", "doctor_profiles")):
        outer = doc.select("document", F.posexplode(source).alias("a", "x")).select("document", "a", F.posexplode("x.reviews").alias("b", "r"))
        part = outer.select(F.lit(order).alias("src_order"), place, "r.*")
        flat = part if flat is None else flat.unionByName(part)
    own = doc.select("document", F.lit(0).alias("a"), F.posexplode("reviews").alias("b", "r")).select(F.lit(3).alias("src_order"), place, "r.*")
    return flat.unionByName(own)


def crawl_entities(doc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Services, clinics and doctors of a crawl, the first of each id; clinics only if a service page names them."""
    pages = doc.select(F.explode("services").alias("s"))
    services = pages.select("s.service.*", (F.size("s.reviews") > 0).alias("listed"), "s.reviews_count_total").where("id > 0").dropDuplicates(["id"])
    named = pages.select(F.explode("s.clinics").alias("c")).select("c.clinic_alias").where(F.col("clinic_alias") != "").distinct()
    clinics = doc.select(F.explode("clinics").alias("c")).select("c.clinic_alias", "c.clinic.*").join(named, "clinic_alias", "left_semi")
    doctors = pages.select(F.explode("s.doctors").alias("d")).select("d.*").where("doctor_id > 0").dropDuplicates(["doctor_id"])
    return services.withColumn("has_reviews", F.col("listed") | (F.coalesce("reviews_count_total", F.lit(0)) > 0)).drop("listed"), clinics, doctors


def fragments(text: Column) -> Column:
    """Of a variant, a string as it is, or what a list's strings and its objects' texts say together; other kinds say nothing."""
    kind = lambda v: F.schema_of_variant(v)
    whole = lambda v: F.try_variant_get(v, "$", "string")
    one = lambda p: F.when(kind(p) == "STRING", whole(p)).when(kind(p).startswith("OBJECT"), F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))).otherwise("")
    parts = F.array_join(F.transform(F.try_variant_get(text, "$", "array<variant>"), one), "")
    return F.when(kind(text) == "STRING", whole(text)).when(kind(text).startswith("ARRAY"), parts)


def message_text(m: dict[str, Column]) -> Column:
    """Text or its fragments, else the entities'; caption; poll; else the sticker: what there is, a line each."""
    body = F.coalesce(T.or_null(fragments(m["text"])), T.or_null(F.array_join(F.transform(m["text_entities"], lambda e: e["text"]), "")))
    poll = F.nullif(F.concat_ws("\n", T.or_null(m["poll"]["question"]), F.array_join(F.transform(m["poll"]["answers"], lambda a: a["text"]), "\n")), F.lit(""))
    said = F.concat_ws("\n", body, T.or_null(fragments(m["caption"])), poll)
    return F.when(said != "", said).otherwise(F.when(T.filled(m["sticker_emoji"]), F.concat(F.lit("[sticker "), m["sticker_emoji"], F.lit("]"))).otherwise(""))


def normalised_messages(each: DataFrame) -> DataFrame:
    """Of (export_key, m: an export's message): export_key, message_id, sent_at, author, text, reply_to, media."""
    m = {f: F.col(f"m.`{f}`") for f in ("text", "text_entities", "caption", "poll", "sticker_emoji")}
    media = F.when(F.col("m.photo").isNotNull(), "photo").when(F.col("m.media_type").isNotNull(), F.col("m.media_type")).when(F.col("m.file").isNotNull(), "file")
    return each.where("m.type = 'message'").select(
        "export_key",
        F.col("m.id").alias("message_id"),
        T.message_time(F.col("m.date"), F.col("m.date_unixtime")).alias("sent_at"),
        F.coalesce(T.or_null(F.col("m.`from`")), T.or_null(F.col("m.actor")), T.or_null(F.col("m.from_id"))).alias("author"),
        message_text(m).alias("text"),
        F.col("m.reply_to_message_id").alias("reply_to"),
        media.alias("media"),
    )


def _exported(doc: DataFrame) -> DataFrame:
    return doc.select(T.export_key(F.col("id").try_cast("bigint"), F.col("name")).alias("export_key"), F.explode("messages").alias("m"))


def chat_messages(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Messages of chat exports, normalised. Each file is one document, which is read as one record; with lines each line is."""
    rows = normalised_messages(_exported(spark.read.schema(EXPORT).option("multiLine", not lines).json(path)))
    return rows.limit(limit) if limit else rows


def split_chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """The messages of chat_messages from files of any size, each one document, whose parts are read by different tasks."""
    found, fields = split.elements(spark, path, "messages")
    value = lambda k: F.max(F.when(F.col("key") == f'"{k}"', F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]))
    keys = fields.groupBy("file").agg(T.export_key(value("id").try_cast("bigint"), value("name")).alias("export_key"))
    each = found.join(keys, "file").select("export_key", F.from_json("element", MESSAGE).alias("m"))
    return normalised_messages(each)


def chat_meta(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """chat_id, name, type and export_key of chat exports; only these columns are parsed."""
    doc = spark.read.schema("id string, name string, type string").option("multiLine", not lines).json(path)
    number = F.col("id").try_cast("bigint")
    return doc.select(number.alias("chat_id"), T.or_null(F.col("name")).alias("name"), "type", T.export_key(number, F.col("name")).alias("export_key"))


def chat_stream(spark: SparkSession, folder: str, files: int = 16, lines: bool = False) -> DataFrame:
    """Messages of exports as they come into a folder, files at a time: for exports that must not be read at once."""
    return normalised_messages(_exported(spark.readStream.schema(EXPORT).option("multiLine", not lines).option("maxFilesPerTrigger", files).json(folder)))


def message_lines(spark: SparkSession, path: str, export_key: str) -> DataFrame:
    """Messages of an export of any size that has a message in each line: lines are split among tasks."""
    lines = spark.read.schema(MESSAGE).json(path)
    return normalised_messages(lines.select(F.lit(export_key).alias("export_key"), F.struct("*").alias("m")))


def page_reviews(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Reviews in a page's microdata: a row for each block with text."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?s)<[^>]+itemprop=[\"']review[\"'].*?(?=<[^>]+itemprop=[\"']review[\"']|$)"), F.lit(0))
    prop = lambda name: T.or_null(F.regexp_replace(F.regexp_extract("block", rf"(?s)itemprop=[\"']{name}[\"'](?:[^>]*content=[\"']([^\"']*)[\"'])?[^>]*>([^<]*)", 1 if name in ("ratingValue", "datePublished") else 2), r"(?U)\s+", " "))
    each = pages.select(F.col(url).alias("source_page_url"), F.posexplode(blocks).alias("pos", "block"))
    return each.select("source_page_url", "pos", prop("author").alias("patient_public_name"), prop("datePublished").alias("created"), prop("ratingValue").try_cast("double").alias("rating_value"), prop("reviewBody").alias("text")).where("text is not null")


def review_payload(df: DataFrame, body: str) -> DataFrame:
    """rows, total and error of a paged review API's answer."""
    value = F.from_json(body, "rows array<string>, reviews array<string>, items array<string>, total bigint, count bigint, totalCount bigint, error string")
    return df.withColumn("_v", value).select("*", F.coalesce("_v.rows", "_v.reviews", "_v.items").alias("rows"), F.coalesce("_v.total", "_v.totalCount", "_v.count").alias("total"), F.col("_v.error").alias("error")).drop("_v")


def canonical_api_review(raw: DataFrame, body: str) -> DataFrame:
    """The 18 columns of a review from an API's nested JSON."""
    kind = "id bigint, text string, answer string, created string, ratingClinic double, publicName string, clinic struct<name: string, alias: string, fullAddress: struct<city: string>>, rating struct<label: string, value: double>, doctor struct<id: bigint, name: string>, service struct<id: bigint, name: string, parentName: string>, directionTitle string, url string"
    v = raw.select(F.from_json(body, kind).alias("v"))
    return v.select(
        F.col("v.id").alias("review_id"), "v.text", "v.answer", F.col("v.rating.value").alias("rating_value"), F.col("v.ratingClinic").alias("rating_clinic"), F.col("v.rating.label").alias("rating_label"),
        F.col("v.publicName").alias("patient_public_name"), F.col("v.clinic.name").alias("clinic_name"), F.col("v.clinic.alias").alias("clinic_alias"), F.col("v.clinic.fullAddress.city").alias("clinic_city"),
        F.nullif("v.doctor.id", F.lit(0)).alias("doctor_id"), F.col("v.doctor.name").alias("doctor_name"), F.col("v.service.id").alias("service_id"), F.col("v.service.name").alias("service_name"),
        F.col("v.service.parentName").alias("parent_service_name"), F.col("v.directionTitle").alias("category_direction_title"), "v.created", F.col("v.url").alias("source_page_url"),
    )


def review_chunks(reviews: DataFrame) -> DataFrame:
    """Reviews as chunks (CHUNK); without those that have no id or text. Columns that reviews lack count as null."""
    c = columns_of(reviews)
    parts = [T.or_null(c(name)) for name in ("parent_service_name", "service_name", "clinic_name")]
    answered, ref = T.filled(c("answer")), c("review_id").cast("string")
    made = {
        "kind": F.lit("review"),
        "ref": ref,
        "title": F.coalesce(F.nullif(F.concat_ws(" — ", *parts), F.lit("")), F.concat(F.lit("Отзыв #"), ref)),
        "body": F.concat(T.strip(c("text")), F.when(answered, F.concat(F.lit("\n\n[Ответ клиники]: "), T.strip(c("answer")))).otherwise("")),
        "service_external_id": T.positive_id(c("service_id")),
        "doctor_external_id": T.positive_id(c("doctor_id")),
        "rating_value": T.first_nonzero_rating(c("rating_value"), c("rating_clinic")),
        "tags": F.when(answered, "answered").otherwise("no_answer"),
    }
    return as_chunks(reviews.where((F.col("review_id") > 0) & T.filled(F.col("text"))), made)


def service_chunks(services: DataFrame) -> DataFrame:
    """Services (id, name, parent_service_name, avg_price, description_plain, synonyms, direction, page_url) as chunks."""
    c = columns_of(services)
    parent, text = T.or_null(c("parent_service_name")), lambda label, value: F.when(T.filled(value), F.concat(F.lit(label), value))
    price = c("avg_price").cast("double")
    lines = [
        F.concat(F.lit("Услуга: "), c("name")),
        F.concat(F.lit("Направление: "), F.coalesce(parent, c("direction"), F.lit(""))),
        F.when(price != 0, F.concat(F.lit("Средняя цена: "), price.cast("string"))),
        text("\n", c("description_plain")),
        text("Синонимы: ", F.array_join(F.slice(c("synonyms").cast("array<string>"), 1, 8), ", ")),
    ]
    made = {
        "kind": F.lit("service"),
        "ref": c("id").cast("string"),
        "title": F.concat_ws(" — ", parent, c("name")),
        "body": F.concat_ws("\n", *lines),
        "service_external_id": c("id"),
        "service_name": c("name"),
        "source_page_url": c("page_url"),
        "tags": F.lit("catalog"),
    }
    return as_chunks(services.where("id > 0 and name <> ''"), made)


def doctor_chunks(doctors: DataFrame) -> DataFrame:
    """Doctors' cards (doctor_id, name, speciality, address, total_rating, reviews_count, price, service names) as chunks."""
    c = columns_of(doctors)
    line = lambda label, value: F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(label), value.cast("string")))
    service = F.when(T.filled(c("service_name")), F.concat_ws(" — ", T.or_null(c("parent_service_name")), c("service_name")))
    lines = [
        line("Врач: ", c("name")),
        line("Специальность: ", c("speciality")),
        line("Услуга: ", service),
        line("Адрес: ", c("address")),
        line("Рейтинг: ", c("total_rating").cast("double")),
        line("Число отзывов: ", c("reviews_count")),
        line("Цена приёма: ", c("price")),
    ]
    made = {
        "kind": F.lit("doctor"),
        "ref": c("doctor_id").cast("string"),
        "title": F.concat_ws(" — ", c("name"), T.or_null(c("speciality"))),
        "body": F.concat_ws("\n", *lines),
        "service_external_id": T.positive_id(c("service_id")),
        "doctor_external_id": c("doctor_id"),
        "doctor_name": c("name"),
        "rating_value": c("total_rating"),
        "source_page_url": c("profile_url"),
        "tags": F.lit("doctor_card"),
    }
    return as_chunks(doctors.where("doctor_id > 0 and name <> ''"), made)


def price_list(df: DataFrame, body: str) -> DataFrame:
    """A map of blocks of prices, as rows (block, name, price)."""
    blocks = F.from_json(body, "map<string, struct<title: string, prices: array<struct<name: string, price: double>>>>")
    return df.select("*", F.explode(blocks).alias("_block", "_v")).select("*", F.explode("_v.prices").alias("_p")).select(*df.columns, F.coalesce("_v.title", "_block").alias("block"), F.col("_p.name").alias("name"), F.col("_p.price").alias("price"))

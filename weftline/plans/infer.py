"""What a field's name says about its values: rules of tokens and scores, overrides by table, and a fallback by shape."""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import tokens as tokens


class Rule(NamedTuple):
    generator: str
    tokens: tuple[str, ...]
    score: float
    veto: tuple[str, ...] = ()


# What a field's tokens mean, and how strongly.
RULES = [
    Rule("number_id", ("id",), 2),
    Rule("uuid", ("uuid",), 15),
    Rule("email", ("email",), 15),
    Rule("full_name", ("name",), 5, ("user", "login", "first", "last", "middle", "nick")),
    Rule("full_name", ("first", "name"), 10),
    Rule("full_name", ("last", "name"), 10),
    Rule("full_name", ("middle", "name"), 10),
    Rule("full_name", ("display", "name"), 10),
    Rule("username", ("username",), 12),
    Rule("username", ("handle",), 10, ("file", "door")),
    Rule("username", ("nickname",), 10),
    Rule("username", ("nick",), 10),
    Rule("username", ("login",), 10),
    Rule("phone", ("phone",), 12),
    Rule("phone", ("mobile",), 12),
    Rule("phone", ("telephone",), 12),
    Rule("phone", ("cell",), 10, ("battery", "grid")),
    Rule("phone", ("fax",), 10),
    Rule("job_title", ("job",), 10),
    Rule("job_title", ("occupation",), 10),
    Rule("job_title", ("designation",), 10),
    Rule("job_title", ("position",), 6, ("lat", "lng", "x", "y", "geo")),
    Rule("role", ("role",), 12),
    Rule("role", ("permission",), 10),
    Rule("role", ("access", "level"), 10),
    Rule("plan", ("plan",), 8, ("floor", "game")),
    Rule("plan", ("tier",), 8),
    Rule("city", ("city",), 12),
    Rule("address", ("address",), 12),
    Rule("country", ("country",), 12),
    Rule("state", ("state",), 10),
    Rule("state", ("province",), 10),
    Rule("state", ("region",), 8),
    Rule("zip_code", ("zip",), 10),
    Rule("zip_code", ("postal",), 10),
    Rule("zip_code", ("postcode",), 10),
    Rule("zip_code", ("pincode",), 10),
    Rule("latitude", ("latitude",), 14),
    Rule("latitude", ("lat",), 12, ("platform", "translate")),
    Rule("longitude", ("longitude",), 14),
    Rule("longitude", ("lng",), 12),
    Rule("longitude", ("lon",), 12, ("color", "colour")),
    Rule("timezone", ("timezone",), 10),
    Rule("timezone", ("tz",), 10),
    Rule("url", ("url",), 14),
    Rule("url", ("website",), 12),
    Rule("url", ("homepage",), 12),
    Rule("url", ("webpage",), 12),
    Rule("url", ("avatar",), 12),
    Rule("url", ("thumbnail",), 12),
    Rule("url", ("link",), 10, ("unlink", "delink")),
    Rule("url", ("image",), 10, ("processing", "recognition")),
    Rule("url", ("photo",), 10),
    Rule("url", ("picture",), 10),
    Rule("url", ("cover",), 8, ("discover", "uncover")),
    Rule("ipv4", ("ip",), 12),
    Rule("user_agent", ("user", "agent"), 12),
    Rule("user_agent", ("ua",), 10),
    Rule("hostname", ("hostname",), 12),
    Rule("hostname", ("host",), 8, ("hostile",)),
    Rule("port", ("port",), 10),
    Rule("protocol", ("protocol",), 10),
    Rule("mime_type", ("mime",), 12),
    Rule("mime_type", ("content", "type"), 10),
    Rule("mime_type", ("media", "type"), 10),
    Rule("mime_type", ("mime", "type"), 10),
    Rule("token", ("token",), 14),
    Rule("token", ("api", "key"), 14),
    Rule("token", ("secret",), 14),
    Rule("token", ("access", "token"), 14),
    Rule("token", ("refresh", "token"), 14),
    Rule("token", ("auth", "token"), 14),
    Rule("token", ("password",), 14),
    Rule("token", ("pwd",), 12),
    Rule("token", ("hash",), 12),
    Rule("token", ("checksum",), 12),
    Rule("token", ("fingerprint",), 12),
    Rule("token", ("signature",), 12),
    Rule("token", ("tracking",), 12),
    Rule("title", ("title",), 12),
    Rule("title", ("subject",), 10, ("course", "education")),
    Rule("content", ("content",), 10),
    Rule("content", ("description",), 10),
    Rule("content", ("bio",), 10),
    Rule("content", ("summary",), 10),
    Rule("content", ("excerpt",), 10),
    Rule("content", ("abstract",), 10),
    Rule("content", ("message",), 10),
    Rule("content", ("body",), 10, ("embodied",)),
    Rule("content", ("note",), 8, ("notable",)),
    Rule("content", ("notes",), 8),
    Rule("content", ("remark",), 8),
    Rule("content", ("details",), 8),
    Rule("content", ("comment",), 8, ("count", "commented")),
    Rule("content", ("text",), 8, ("context", "subtext")),
    Rule("reason", ("reason",), 10),
    Rule("error_message", ("error",), 10),
    Rule("error_message", ("exception",), 10),
    Rule("slug", ("slug",), 14),
    Rule("slug", ("permalink",), 12),
    Rule("company", ("company",), 12),
    Rule("company", ("brand",), 10),
    Rule("company", ("organization",), 10),
    Rule("company", ("vendor",), 10),
    Rule("company", ("supplier",), 10),
    Rule("company", ("merchant",), 10),
    Rule("company", ("org",), 8),
    Rule("bank", ("bank",), 12),
    Rule("currency", ("currency",), 12),
    Rule("amount", ("amount",), 10),
    Rule("price", ("price",), 12),
    Rule("cost", ("cost",), 10),
    Rule("balance", ("balance",), 10),
    Rule("salary", ("salary",), 10),
    Rule("revenue", ("revenue",), 10),
    Rule("percent50", ("discount",), 10),
    Rule("tax_type", ("tax",), 12),
    Rule("tax_rate", ("tax", "rate"), 10),
    Rule("payment_method", ("payment", "method"), 12),
    Rule("transaction_type", ("transaction",), 10),
    Rule("investment_type", ("investment",), 10),
    Rule("investment_type", ("asset",), 10),
    Rule("sku", ("sku",), 12),
    Rule("order_number", ("order", "number"), 12),
    Rule("invoice_number", ("invoice",), 12),
    Rule("token", ("reference",), 10),
    Rule("ticket_number", ("ticket",), 10, ("movie", "concert", "flight")),
    Rule("programming_language", ("language",), 12),
    Rule("programming_language", ("stack",), 10),
    Rule("cloud_provider", ("cloud", "provider"), 12),
    Rule("database", ("database",), 12),
    Rule("database", ("db",), 12),
    Rule("semver", ("version",), 12),
    Rule("semver", ("semver",), 12),
    Rule("framework", ("framework",), 10),
    Rule("resolution", ("resolution",), 10),
    Rule("resolution", ("display",), 10),
    Rule("device_type", ("device",), 12),
    Rule("operating_system", ("os",), 10),
    Rule("hex_color", ("color",), 12),
    Rule("hex_color", ("colour",), 12),
    Rule("hex_color", ("hex",), 10),
    Rule("locale", ("locale",), 12),
    Rule("locale", ("lang",), 10, ("language",)),
    Rule("quantity", ("quantity",), 12),
    Rule("quantity", ("qty",), 12),
    Rule("counter", ("count",), 10, ("account", "discount")),
    Rule("total", ("total",), 8, ("subtotal",)),
    Rule("age", ("age",), 15),
    Rule("score", ("score",), 12),
    Rule("rating", ("rating",), 12),
    Rule("views", ("view",), 12),
    Rule("views", ("views",), 12),
    Rule("likes", ("like",), 10),
    Rule("likes", ("likes",), 10),
    Rule("followers", ("followers",), 12),
    Rule("percent", ("percentage",), 12),
    Rule("percent", ("percent",), 12),
    Rule("ratio", ("ratio",), 12),
    Rule("duration", ("duration",), 10),
    Rule("seconds", ("seconds",), 10),
    Rule("minutes", ("minutes",), 10),
    Rule("hours", ("hours",), 10),
    Rule("elapsed", ("elapsed",), 10),
    Rule("priority", ("priority",), 12),
    Rule("ordinal", ("order",), 8, ("order_number", "order_id")),
    Rule("created_at", ("created",), 12),
    Rule("updated_at", ("updated",), 12),
    Rule("updated_at", ("modified",), 12),
    Rule("deleted_at", ("deleted",), 12),
    Rule("published_at", ("published",), 10),
    Rule("expires_at", ("expires",), 12),
    Rule("recent_at", ("timestamp",), 10),
    Rule("birth_date", ("birth", "date"), 12),
    Rule("birth_date", ("dob",), 12),
    Rule("status", ("status",), 12),
    Rule("flag80", ("active",), 10, ("radioactive", "proactive")),
    Rule("flag70", ("verified",), 10),
    Rule("flag90", ("enabled",), 10),
    Rule("flag05", ("is", "deleted"), 10),
    Rule("flag70", ("is", "published"), 10),
    Rule("flag25", ("premium",), 10),
    Rule("interaction", ("interaction",), 10),
    Rule("interaction", ("action",), 10),
    Rule("university", ("university",), 12),
    Rule("university", ("college",), 12),
    Rule("university", ("school",), 10),
    Rule("subject", ("course",), 12),
    Rule("certification", ("certification",), 12),
    Rule("certification", ("certificate",), 12),
    Rule("carrier", ("carrier",), 12),
    Rule("carrier", ("shipper",), 12),
    Rule("unit", ("unit",), 10),
    Rule("unit", ("measure",), 10),
    Rule("unit", ("weight",), 10),
    Rule("car_make", ("make",), 12),
    Rule("car_make", ("car",), 12),
    Rule("car_make", ("vehicle",), 12),
    Rule("car_model", ("model",), 8, ("data", "schema", "language")),
    Rule("genre", ("genre",), 12),
    Rule("genre", ("category",), 8, ("product", "company")),
    Rule("year", ("year",), 12),
    Rule("year", ("release", "year"), 14),
    Rule("product_name", ("product",), 12),
    Rule("employment_type", ("employment",), 12),
    Rule("employment_type", ("contract",), 12),
    Rule("employment_type", ("work", "arrangement"), 10),
    Rule("department", ("department",), 12),
    Rule("medical_specialty", ("specialty",), 12),
    Rule("vital_type", ("vital",), 12),
    Rule("vital_type", ("measurement",), 12),
    Rule("property_type", ("property",), 12),
    Rule("property_type", ("building",), 12),
    Rule("cuisine", ("cuisine",), 12),
    Rule("cuisine", ("food",), 12),
    Rule("social_platform", ("platform",), 10, ("company", "cloud", "game")),
    Rule("sentiment", ("sentiment",), 12),
    Rule("sentiment", ("mood",), 12),
    Rule("hashtag", ("hashtag",), 12),
    Rule("hashtag", ("tags",), 8),
    Rule("ministry", ("ministry",), 12),
    Rule("ministry", ("govt",), 12),
    Rule("ministry", ("authority",), 10),
    Rule("iso_code", ("iso", "code"), 12),
    Rule("case_status", ("case", "status"), 12),
    Rule("legal_document", ("legal",), 12),
    Rule("legal_document", ("agreement",), 12),
    Rule("id_type", ("id", "type"), 12),
    Rule("pan_card", ("pan",), 14),
    Rule("aadhaar", ("aadhaar",), 14),
    Rule("planet", ("planet",), 12),
    Rule("planet", ("star",), 12),
    Rule("element", ("element",), 12),
    Rule("element", ("chemical",), 12),
    Rule("organ", ("organ",), 12),
    Rule("organ", ("anatomy",), 12),
    Rule("animal", ("animal",), 12),
    Rule("animal", ("pet",), 12),
    Rule("plant", ("plant",), 12),
    Rule("plant", ("flower",), 12),
    Rule("weather", ("weather",), 12),
    Rule("weather", ("condition",), 12),
    Rule("energy_source", ("energy", "source"), 12),
    Rule("energy_source", ("energy",), 10),
    Rule("energy_source", ("fuel",), 10),
    Rule("crop", ("crop",), 12),
    Rule("crop", ("produce",), 12),
    Rule("airline", ("airline",), 12),
    Rule("flight_number", ("flight", "number"), 12),
    Rule("flight_status", ("flight", "status"), 12),
    Rule("amenity", ("amenity",), 12),
    Rule("instrument", ("instrument",), 12),
    Rule("instrument", ("music",), 12),
    Rule("sport", ("sport",), 12),
    Rule("sport", ("game",), 12),
    Rule("gaming_platform", ("gaming", "platform"), 12),
    Rule("material", ("material",), 12),
    Rule("material", ("raw",), 12),
    Rule("tool", ("tool",), 12),
    Rule("tool", ("equipment",), 12),
    Rule("marketing_channel", ("channel",), 12),
    Rule("marketing_channel", ("marketing",), 12),
    Rule("marketing_channel", ("source",), 6, ("user", "lead", "data")),
    Rule("clothing_type", ("clothing",), 12),
    Rule("clothing_type", ("apparel",), 12),
    Rule("size", ("size",), 10),
    Rule("isp", ("isp",), 12),
]

# In tables whose name holds one of the words, a plain name or title means this.
OVERRIDES = {
    "product_name": ("product item catalog inventory", ("name", "title")),
    "movie_title": ("movie film show episode", ("name", "title")),
    "title": ("post article blog news", ("name", "title")),
    "full_name": ("user customer employee person people patient doctor student agent citizen creator profile member contact", ("name",)),
}

#: Names that the registered query scores.
SAMPLE_FIELDS = ["id", "email", "full_name", "first_name", "created_at", "updatedAt", "user_agent", "price", "total_amount", "order_number", "tax_rate", "latitude", "is_active", "release_year", "payment_method", "c_name", "o_orderstatus", "p_brand", "event_type", "flight_status", "access_token", "views", "comment_count", "platform", "shipping_address", "phone_number", "content_type", "position_x"]


def register_rule(generator: str, names: str | list[str], score: float, veto: tuple[str, ...] = ()) -> Rule:
    """A further rule; names: the tokens that must all be there."""
    rule = Rule(generator, tuple(names.split("+") if isinstance(names, str) else names), score, tuple(veto))
    RULES.append(rule)
    infer.cache_clear()
    return rule


def score(rule: Rule, own: list[str]) -> float | None:
    """None if the rule doesn't fit; a bonus if it explains every token, a small loss for each token that it leaves."""
    if not set(rule.tokens) <= set(own) or set(rule.veto) & set(own):
        return None
    return rule.score + (5 if len(rule.tokens) == len(own) else -0.5 * max(0, len(own) - len(rule.tokens)))


@cache
def infer(field: str, table: str = "") -> str:
    """The generator for a field's values."""
    own, low = tokens(field), table.lower()
    for generator, (words, names) in OVERRIDES.items():
        if field.lower() in names and any(w in low for w in words.split()):
            return generator
    best, at = None, -1.0
    for r in RULES:
        s = score(r, own)
        if s is not None and s > at:
            best, at = r.generator, s
    return best or by_shape(field)


def by_shape(field: str) -> str:
    low = field.lower()
    if low.endswith(("at", "_on")) or "time" in low or "date" in low:
        return "created_at"
    if low.endswith(("id", "uuid")):
        return "uuid"
    if low.startswith(("is_", "has_", "can_", "should_")):
        return "flag70"
    if low.endswith(("_count", "_num", "_no", "_number")):
        return "count1000"
    if low.endswith(("url", "_link", "_href")):
        return "url"
    return "full_name" if low.endswith("name") else "word"


def score_table(spark: SparkSession, fields: list[str]) -> DataFrame:
    """field, generator and score of the best rule for each field, from a table of rules: as a query, for many schemas at once."""
    rules = spark.createDataFrame([(k, r.generator, list(r.tokens), float(r.score), list(r.veto)) for k, r in enumerate(RULES)], "no int, generator string, need array<string>, score double, veto array<string>")
    named = spark.createDataFrame([(f, tokens(f)) for f in fields], "field string, tok array<string>")
    # a rule is reached by its first token
    both = named.withColumn("first", F.explode(F.array_distinct("tok"))).join(rules.withColumn("first", F.get("need", F.lit(0))), "first")
    both = both.where((F.size(F.array_except("need", "tok")) == 0) & ~F.arrays_overlap("tok", "veto"))
    n, m = F.size("need"), F.size("tok")
    value = F.col("score") + F.when(n == m, F.lit(5.0)).otherwise(-0.5 * F.greatest(m - n, F.lit(0)))
    best = both.groupBy("field").agg(F.max(F.struct(value.alias("s"), (-F.col("no")).alias("k"), "generator")).alias("b"))
    return best.select("field", "b.generator", F.col("b.s").alias("score"))

"""Values by meaning: a generator's name to an expression over uniform draws. Lists are short; longer ones can be given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import draws as D
from .hashing import hash_digits, uniform

CORPORA: dict[str, list[str]] = {
    "given_names": ["Ana", "Ben", "Chloe", "David", "Elena", "Farid", "Grace", "Hugo", "Ines", "Jonas", "Kira", "Liam", "Mei", "Noah", "Olga", "Pedro", "Quinn", "Rosa", "Samir", "Tara", "Uma", "Viktor", "Wendy", "Yusuf"],
    "family_names": ["Adler", "Brown", "Costa", "Dubois", "Evans", "Fischer", "Garcia", "Hansen", "Ito", "Jensen", "Kowalski", "Lopez", "Meyer", "Novak", "Okafor", "Park", "Rossi", "Silva", "Tanaka", "Weber"],
    "given_names_india": ["Aarav", "Aditi", "Arjun", "Diya", "Ishaan", "Kavya", "Lakshmi", "Meera", "Nikhil", "Priya", "Rahul", "Rohan", "Sanya", "Vikram"],
    "family_names_india": ["Agarwal", "Banerjee", "Chopra", "Desai", "Gupta", "Iyer", "Joshi", "Kapoor", "Mehta", "Nair", "Patel", "Reddy", "Sharma", "Singh", "Verma"],
    "domains": ["example.com", "example.org", "mail.example.net", "corp.example.com", "inbox.example.org"],
    "companies": ["Northwind Labs", "Blue Harbor", "Acorn Systems", "Summit Foods", "Vertex Motors", "Lumen Energy", "Cedar Health", "Orbit Media", "Harvest Bank", "Pioneer Steel"],
    "job_titles": ["Accountant", "Analyst", "Architect", "Designer", "Developer", "Director", "Engineer", "Manager", "Nurse", "Researcher", "Sales Lead", "Teacher", "Technician"],
    "product_names": ["Desk Lamp", "Travel Mug", "Running Shoes", "Wireless Mouse", "Yoga Mat", "Water Bottle", "Office Chair", "Notebook", "Headphones", "Backpack"],
    "movie_titles": ["The Long Winter", "Paper Moons", "City of Rivers", "A Quiet Signal", "The Last Orchard", "Northern Lights", "Broken Compass", "Second Tide"],
    "genres": ["Action", "Comedy", "Documentary", "Drama", "Fantasy", "Horror", "Mystery", "Romance", "Thriller"],
    "cities": ["Amsterdam", "Boston", "Cairo", "Delhi", "Lagos", "Lima", "London", "Madrid", "Mumbai", "Nairobi", "Oslo", "Paris", "Seoul", "Sydney", "Tokyo", "Toronto"],
    "countries": ["Argentina", "Brazil", "Canada", "Egypt", "France", "Germany", "India", "Japan", "Kenya", "Mexico", "Nigeria", "Norway", "Spain", "United Kingdom", "United States"],
    "states": ["California", "Colorado", "Florida", "Georgia", "Illinois", "Maine", "Nevada", "Ohio", "Oregon", "Texas", "Utah", "Washington"],
    "states_india": ["Assam", "Gujarat", "Karnataka", "Kerala", "Maharashtra", "Punjab", "Rajasthan", "Tamil Nadu", "West Bengal"],
    "streets": ["Oak Street", "Main Street", "Park Avenue", "Hill Road", "Lake Drive", "Mill Lane", "River Road", "Station Road"],
    "banks": ["First Harbor Bank", "Unity Savings", "Meridian Trust", "Coastal Credit", "Granite Bank"],
    "carriers": ["Swift Freight", "Blue Parcel", "Trans Global", "Road Runner Cargo", "Sky Post"],
    "universities": ["Lakeside University", "Northern Institute", "Riverside College", "Central Technical University", "Harbor University"],
    "car_makes": ["Aster", "Bolt", "Corvo", "Dynamo", "Eagle", "Falcon", "Giga", "Horizon"],
    "car_models": ["Sedan S", "Coupe C", "Wagon W", "Roadster R", "Truck T", "Van V"],
    "user_agents": ["Mozilla/5.0 (X11; Linux x86_64) Firefox/128.0", "Mozilla/5.0 (Windows NT 10.0) Chrome/126.0", "Mozilla/5.0 (Macintosh) Safari/17.5", "Mozilla/5.0 (iPhone) Mobile Safari/17.4"],
    "payment_methods": ["credit card", "debit card", "bank transfer", "cash", "gift card", "mobile wallet", "invoice"],
    "tax_types": ["VAT", "GST", "sales tax", "income tax", "customs duty", "excise"],
    "case_statuses": ["open", "in review", "hearing scheduled", "settled", "dismissed", "closed", "appealed"],
    "units": ["kg", "g", "lb", "oz", "t", "l", "ml", "m", "cm", "km", "piece", "box"],
    "resolutions": ["1280x720", "1920x1080", "2560x1440", "3840x2160", "7680x4320"],
    "protocols": ["HTTP", "HTTPS", "FTP", "SSH", "SMTP", "MQTT", "WebSocket", "gRPC"],
    "sentiments": ["positive", "neutral", "negative", "mixed"],
    "social_platforms": ["PhotoShare", "MicroBlog", "VideoTube", "ChatRoom", "ProLink"],
    "vital_types": ["heart rate", "blood pressure", "temperature", "oxygen saturation", "respiratory rate", "glucose"],
    "iso_codes": ["AR", "BR", "CA", "DE", "EG", "ES", "FR", "GB", "IN", "JP", "KE", "MX", "NG", "NO", "US"],
    "flight_statuses": ["scheduled", "boarding", "departed", "in air", "landed", "delayed", "cancelled", "diverted"],
    "planets": ["Mercury", "Venus", "Earth", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune"],
    "instruments": ["piano", "violin", "guitar", "drums", "flute", "cello", "trumpet", "harp"],
    "tools": ["hammer", "drill", "saw", "wrench", "level", "crane", "excavator", "ladder"],
    "crops": ["wheat", "rice", "maize", "barley", "cotton", "soy", "potato", "coffee"],
    "organs": ["heart", "liver", "lung", "kidney", "brain", "stomach", "skin", "pancreas"],
    "elements": ["hydrogen", "helium", "carbon", "nitrogen", "oxygen", "sodium", "iron", "copper", "silver", "gold"],
    "interactions": ["view", "click", "like", "share", "comment", "follow", "save", "purchase"],
    "order_statuses": ["pending", "paid", "packed", "shipped", "delivered", "returned", "refunded", "cancelled"],
    "statuses": ["active", "inactive", "pending", "approved", "rejected", "archived", "draft"],
    "cloud_providers": ["Alpha Cloud", "Beta Compute", "Gamma Stack", "Delta Host"],
    "databases": ["PostgreSQL", "MySQL", "SQLite", "MongoDB", "Redis", "Cassandra", "ClickHouse"],
    "animals": ["cat", "dog", "horse", "eagle", "dolphin", "otter", "tiger", "owl", "fox"],
    "plants": ["rose", "tulip", "oak", "fern", "lotus", "maple", "orchid", "cactus"],
    "timezones": ["UTC", "Europe/Paris", "Europe/London", "America/New_York", "America/Sao_Paulo", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney"],
    "sports": ["football", "tennis", "cricket", "hockey", "swimming", "rowing", "chess", "cycling"],
    "subjects": ["algebra", "biology", "chemistry", "economics", "geography", "history", "literature", "physics"],
    "certifications": ["Project Management", "Cloud Practitioner", "First Aid", "Data Analyst", "Security Auditor"],
    "amenities": ["pool", "gym", "parking", "breakfast", "wifi", "spa", "bar", "airport shuttle"],
    "investment_types": ["stock", "bond", "fund", "real estate", "commodity", "savings"],
    "marketing_channels": ["email", "search", "social", "display", "affiliate", "referral", "direct", "events"],
    "gaming_platforms": ["PC", "console", "handheld", "mobile", "cloud", "arcade"],
    "materials": ["steel", "aluminium", "copper", "glass", "wood", "plastic", "rubber", "concrete"],
    "legal_documents": ["contract", "deed", "will", "lease", "patent", "affidavit", "power of attorney"],
    "id_types": ["passport", "driving licence", "national id", "residence permit"],
    "id_types_india": ["aadhaar", "pan", "voter id", "passport", "ration card"],
    "weather": ["sunny", "cloudy", "rain", "snow", "storm", "fog", "windy", "hail"],
    "device_types": ["phone", "tablet", "laptop", "desktop", "watch", "television", "sensor"],
    "clothing": ["shirt", "trousers", "dress", "jacket", "skirt", "coat", "sweater", "socks"],
    "energy_sources": ["solar", "wind", "hydro", "nuclear", "gas", "coal", "biomass", "geothermal"],
    "airlines": ["Aero North", "Blue Wing", "Condor Line", "Delta Sky", "Eastern Air"],
    "employment_types": ["full time", "part time", "contract", "internship", "freelance", "remote"],
    "departments": ["Engineering", "Finance", "Legal", "Marketing", "Operations", "People", "Sales", "Support"],
    "property_types": ["apartment", "house", "villa", "studio", "office", "warehouse", "land"],
    "cuisines": ["French", "Indian", "Italian", "Japanese", "Lebanese", "Mexican", "Thai", "Turkish"],
    "isps": ["FiberOne", "NetWave", "Skyline Internet", "MetroConnect", "RuralNet"],
    "ministries": ["Agriculture", "Defence", "Education", "Finance", "Health", "Home Affairs", "Railways", "Science"],
    "specialties": ["cardiology", "dermatology", "neurology", "oncology", "orthopedics", "pediatrics", "psychiatry", "radiology"],
    "hashtags": ["#travel", "#food", "#music", "#tech", "#fitness", "#nature", "#art", "#news"],
    "programming_languages": ["Python", "Java", "Scala", "Go", "Rust", "C", "JavaScript", "SQL", "Kotlin", "Ruby"],
    "frameworks": ["Django", "Flask", "Spring", "Rails", "Express", "Laravel", "Angular", "React", "Vue", "Svelte"],
    "currencies": ["USD", "EUR", "GBP", "INR", "JPY", "CAD", "AUD", "CHF", "CNY", "BRL"],
    "mime_types": ["text/html", "text/plain", "application/json", "application/pdf", "image/png", "image/jpeg", "audio/mpeg", "video/mp4"],
    "locales": ["en-US", "en-GB", "fr-FR", "de-DE", "es-ES", "pt-BR", "hi-IN", "ja-JP"],
    "roles": ["admin", "editor", "viewer", "owner", "member", "guest", "moderator", "support"],
    "plans": ["free", "basic", "pro", "business", "enterprise"],
    "operating_systems": ["Linux", "Windows", "macOS", "Android", "iOS", "ChromeOS"],
    "transaction_types": ["deposit", "withdrawal", "transfer", "payment", "refund", "fee"],
    "reasons": ["duplicate", "expired", "requested by user", "policy", "out of stock", "damaged", "other"],
    "errors": ["connection timed out", "permission denied", "resource not found", "invalid argument", "quota exceeded", "internal error"],
    "sizes": ["XS", "S", "M", "L", "XL", "XXL"],
    "words": ["amber", "brook", "cloud", "delta", "ember", "field", "grove", "haven", "inlet", "jade", "knoll", "lumen", "mesa", "north", "opal", "pine", "quartz", "ridge", "stone", "vale"],
    "sentences": ["The order arrived on time.", "We will follow up next week.", "Please review the attached notes.", "The team agreed on a plan.", "Results look better than expected.", "Nothing else was changed.", "A short summary is below.", "Costs stayed within budget.", "The service was restarted.", "Feedback has been positive.", "The next step is testing.", "All checks have passed."],
    "ports": ["22", "25", "80", "443", "3000", "5432", "6379", "8080", "8443", "9092"],
    "topics": ["Data Quality", "Urban Gardening", "Remote Teams", "Stream Processing", "Home Cooking", "Trail Running", "Open Data", "Event Planning", "Battery Care", "Photography"],
    "titles": ["{Topic} in Practice", "Notes on {Topic}", "{Topic} for Beginners", "A Field Guide to {Topic}", "{Topic} at {Company}", "Questions about {Topic}"],
    "article_titles": ["What {Topic} Taught Us", "Ten Facts about {Topic}", "{Topic} Comes to {City}", "Why {Topic} Matters Now", "Inside {Company}: {Topic}"],
}

DAY_MS = 86_400_000


@dataclass
class Context:
    """Where a value is drawn: seed, table, field and row index."""

    seed: object
    table: str
    name: str
    index: Column
    as_of: str = "2024-01-01 00:00:00"
    corpora: dict[str, list[str]] = field(default_factory=dict)

    def u(self, draw: int = 0) -> Column:
        return uniform(self.seed, self.table, self.name, self.index, draw=draw)

    def digits(self) -> Column:
        return hash_digits(self.seed, self.table, self.name, self.index)

    def listed(self, corpus: str) -> list[str]:
        """A list, its local form where the table or field names India, its built-in form where none is given."""
        local = f"{corpus}_india"
        if "india" in f"{self.table}_{self.name}".lower() and (local in self.corpora or local in CORPORA):
            corpus = local
        return self.corpora.get(corpus) or CORPORA[corpus]

    def pick(self, corpus: str, draw: int = 0) -> Column:
        return D.pick(self.u(draw), self.listed(corpus))

    def ago(self, days: int, draw: int = 0) -> Column:
        """A time up to so many days before as_of, as epoch milliseconds; after it for negative days."""
        now = F.unix_millis(F.lit(self.as_of).cast("timestamp"))
        return now - F.floor(self.u(draw) * F.lit(float(days * DAY_MS))).cast("long")


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def digits_text(c: Context, n: int, draw: int = 0) -> Column:
    return F.lpad(F.floor(c.u(draw) * F.lit(float(10**n))).cast("long").cast("string"), n, "0")


def full_name(c: Context) -> Column:
    return F.concat_ws(" ", c.pick("given_names", 1), c.pick("family_names", 2))


def username(c: Context) -> Column:
    number_ = F.when(c.u(4) < 0.5, D.integer(c.u(5), 1, 999).cast("string")).otherwise("")
    return F.lower(F.concat(c.pick("given_names", 1), D.pick(c.u(3), ["_", ".", ""]), c.pick("family_names", 2), number_))


def email(c: Context) -> Column:
    number_ = F.when(c.u(4) < 0.6, D.integer(c.u(5), 1, 999).cast("string")).otherwise("")
    return F.concat(F.lower(c.pick("given_names", 1)), F.lit("."), F.lower(c.pick("family_names", 2)), number_, F.lit("@"), c.pick("domains", 3))


def content(c: Context) -> Column:
    """2, 4 or 8 different sentences, by hash order."""
    own = F.array(*[F.lit(s) for s in c.listed("sentences")])
    start = D.integer(c.u(1), 0, len(c.listed("sentences")) - 1)
    n = D.pick(c.u(0), [2, 4, 8])
    step = D.pick(c.u(2), [s for s in (1, 5, 7, 11) if len(c.listed("sentences")) % s or s == 1])
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(own, F.pmod(start + k * step, F.lit(len(c.listed("sentences")))).cast("int"))), " ")


def url(c: Context) -> Column:
    image = any(x in c.name.lower() for x in ("image", "avatar", "photo", "thumbnail", "picture", "cover"))
    return F.concat(F.lit("https://img." if image else "https://www."), c.pick("words", 1), F.lit(".example.com/"), c.pick("words", 2), F.lit("/"), digits_text(c, 5, 3), F.lit(".jpg" if image else ""))


def slug(c: Context) -> Column:
    return F.concat(c.pick("words", 1), F.lit("-"), c.pick("words", 2), F.when(c.u(3) < 0.4, F.concat(F.lit("-"), D.integer(c.u(4), 1, 99).cast("string"))).otherwise(""))


def near(mean: float, sd: float, low: float = 0.0, places: int = 2):
    return lambda c: F.round(F.greatest(D.normal(c.u(0), c.u(1), mean, sd), F.lit(low)), places)


def status(c: Context) -> Column:
    low = c.table.lower()
    return c.pick("order_statuses" if "order" in low else "case_statuses" if "case" in low else "flight_statuses" if "flight" in low else "statuses")


def letters(c: Context, n: int, draw: int) -> Column:
    return F.concat(*[F.char(F.lit(65) + F.floor(c.u(draw + k) * 26.0).cast("int")) for k in range(n)])


def from_template(c: Context, templates: str, draw: int = 0) -> Column:
    """One of a list of templates, each {name} in it replaced by one of the list that the name stands for (PLACEHOLDERS)."""
    out = c.pick(templates, draw)
    for k, (name, corpus) in enumerate(PLACEHOLDERS.items()):
        if any(f"{{{name}}}" in t for t in c.listed(templates)):
            out = F.replace(out, F.lit(f"{{{name}}}"), c.pick(corpus, draw + 1 + k))
    return out


def title(c: Context) -> Column:
    """By the table: articles and posts have other templates than the rest; products and films their own names."""
    low = f"{c.table}_{c.name}".lower()
    if "product" in low:
        return c.pick("product_names", 1)
    return from_template(c, "article_titles" if any(x in low for x in ("post", "article", "blog", "news")) else "titles", 1)


#: What a template's placeholders are replaced by.
PLACEHOLDERS = {"Topic": "topics", "City": "cities", "Company": "companies", "Word": "words"}

Generator = Callable[[Context], Column]
FROM_LIST = {
    "job_title": "job_titles", "product_name": "product_names", "movie_title": "movie_titles", "genre": "genres", "city": "cities", "country": "countries", "state": "states", "bank": "banks",
    "carrier": "carriers", "university": "universities", "car_make": "car_makes", "car_model": "car_models", "user_agent": "user_agents", "payment_method": "payment_methods", "tax_type": "tax_types",
    "case_status": "case_statuses", "unit": "units", "resolution": "resolutions", "protocol": "protocols", "sentiment": "sentiments", "social_platform": "social_platforms", "vital_type": "vital_types",
    "iso_code": "iso_codes", "flight_status": "flight_statuses", "planet": "planets", "instrument": "instruments", "tool": "tools", "crop": "crops", "organ": "organs", "element": "elements",
    "interaction": "interactions", "cloud_provider": "cloud_providers", "database": "databases", "animal": "animals", "plant": "plants", "timezone": "timezones", "sport": "sports", "subject": "subjects",
    "certification": "certifications", "amenity": "amenities", "investment_type": "investment_types", "marketing_channel": "marketing_channels", "gaming_platform": "gaming_platforms", "material": "materials",
    "legal_document": "legal_documents", "id_type": "id_types", "weather": "weather", "device_type": "device_types", "clothing_type": "clothing", "energy_source": "energy_sources", "airline": "airlines",
    "employment_type": "employment_types", "department": "departments", "property_type": "property_types", "cuisine": "cuisines", "isp": "isps", "ministry": "ministries", "medical_specialty": "specialties",
    "hashtag": "hashtags", "programming_language": "programming_languages", "framework": "frameworks", "currency": "currencies", "mime_type": "mime_types", "locale": "locales", "role": "roles", "plan": "plans",
    "operating_system": "operating_systems", "transaction_type": "transaction_types", "reason": "reasons", "error_message": "errors", "size": "sizes", "company": "companies", "port": "ports",
}

TEXT: dict[str, Generator] = {
    **{name: (lambda c, k=corpus: c.pick(k)) for name, corpus in FROM_LIST.items()},
    "full_name": full_name, "username": username, "email": email, "content": content, "url": url, "slug": slug, "status": status,
    "title": title,
    "phone": lambda c: F.concat(F.lit("+1"), digits_text(c, 10)),
    "address": lambda c: F.concat(D.integer(c.u(1), 1, 999).cast("string"), F.lit(" "), c.pick("streets", 2), F.lit(", "), c.pick("cities", 3)),
    "zip_code": lambda c: digits_text(c, 6 if "india" in f"{c.table}_{c.name}".lower() else 5),
    "uuid": lambda c: F.concat_ws("-", *[F.substring(c.digits(), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
    "token": lambda c: c.digits(),
    "word": lambda c: F.substring(c.digits(), 1, 12),
    "ipv4": lambda c: F.concat_ws(".", *[D.integer(c.u(k), 1, 254).cast("string") for k in range(4)]),
    "hostname": lambda c: F.concat(c.pick("words", 1), F.lit("-"), digits_text(c, 2, 2)),
    "sku": lambda c: F.concat(F.lit("SKU-"), F.upper(F.lpad(F.conv(F.floor(c.u() * float(36**6)).cast("long").cast("string"), 10, 36), 6, "0"))),
    "order_number": lambda c: F.concat(F.lit("ORD-"), digits_text(c, 8)),
    "invoice_number": lambda c: F.concat(F.lit("INV-"), digits_text(c, 7)),
    "ticket_number": lambda c: F.concat(F.lit("TKT-"), digits_text(c, 6)),
    "flight_number": lambda c: F.concat(F.lit("FL"), digits_text(c, 4)),
    "pan_card": lambda c: F.concat(letters(c, 5, 1), digits_text(c, 4, 10), letters(c, 1, 11)),
    "aadhaar": lambda c: F.concat_ws(" ", *[digits_text(c, 4, k) for k in range(3)]),
    "hex_color": lambda c: F.concat(F.lit("#"), F.substring(c.digits(), 1, 6)),
    "semver": lambda c: F.concat_ws(".", *[D.integer(c.u(k), 0, n - 1).cast("string") for k, n in enumerate((5, 20, 50))]),
    "priority": lambda c: D.weighted(c.u(), {"low": 0.40, "medium": 0.35, "high": 0.17, "critical": 0.08}),
    "created_at": lambda c: iso(c.ago(365)), "updated_at": lambda c: iso(c.ago(30)), "published_at": lambda c: iso(c.ago(180)), "recent_at": lambda c: iso(c.ago(30)), "expires_at": lambda c: iso(c.ago(-365)),
    "deleted_at": lambda c: F.when(c.u(1) >= 0.7, iso(c.ago(30))),
    "birth_date": lambda c: F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), D.integer(c.u(), 0, 20088).cast("int")), "yyyy-MM-dd"),
    "year": lambda c: D.integer(c.u(), 1950, 2024).cast("string"),
}

NUMBER: dict[str, Generator] = {
    "number_id": lambda c: D.integer(c.u(), 0, 999_999),
    "amount": near(1000, 500), "price": near(49.99, 30, 0.5), "cost": near(250, 100), "balance": near(5000, 2000), "salary": near(85000, 30000), "revenue": near(500000, 200000), "total": near(1500, 800),
    "percent50": lambda c: D.integer(c.u(), 0, 50), "percent": lambda c: D.integer(c.u(), 0, 100), "ratio": lambda c: F.round(c.u(), 2), "tax_rate": lambda c: F.round(c.u() * 30.0, 2),
    "quantity": near(10, 5, 1, 0), "age": near(32, 12, 1, 0), "score": lambda c: F.least(near(75, 15)(c), F.lit(100.0)), "rating": lambda c: F.least(near(4.2, 0.8, 1, 1)(c), F.lit(5.0)),
    "counter": lambda c: D.zipf(c.u(), 500, 1.3), "views": lambda c: D.zipf(c.u(), 10_000, 1.1), "likes": lambda c: D.zipf(c.u(), 5_000, 1.2), "followers": lambda c: D.zipf(c.u(), 50_000, 1.2),
    "duration": near(300, 200, 1, 0), "elapsed": near(1200, 600, 1, 0), "seconds": lambda c: D.integer(c.u(), 0, 3599), "minutes": lambda c: D.integer(c.u(), 0, 59), "hours": lambda c: D.integer(c.u(), 0, 23),
    "count1000": lambda c: D.integer(c.u(), 0, 999), "ordinal": lambda c: D.integer(c.u(), 1, 1000), "latitude": lambda c: F.round(D.number(c.u(), -90, 90), 6), "longitude": lambda c: F.round(D.number(c.u(), -180, 180), 6),
    "year": lambda c: D.integer(c.u(), 1950, 2024), "port": lambda c: D.pick(c.u(), CORPORA["ports"]).cast("int"),
}

FLAG: dict[str, Generator] = {f"flag{p:02d}": (lambda c, p=p: c.u() < p / 100) for p in (5, 25, 50, 70, 80, 90)}
TEXT |= {k: (lambda c, f=f: f(c).cast("string")) for k, f in (NUMBER | FLAG).items() if k not in TEXT}


def register(name: str, generator: Generator) -> None:
    TEXT[name] = generator


def load_corpora(folder_df) -> dict[str, list[str]]:
    """name -> values from a DataFrame (name, value), such as spark.read of a folder of lists. Lists are metadata: short."""
    return {r["name"]: r["values"] for r in folder_df.groupBy("name").agg(F.sort_array(F.collect_set("value")).alias("values")).collect()}

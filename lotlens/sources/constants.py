"""Constant relations. They must be as they are for results to agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.sources import schemas

#: Plans: id, name, searches_limit, requests_month, requests_hour, price_uah, description, features. The first is the default.
PLANS = (
    ("free", "Безкоштовно", 1, 1000, 30, 0, "Для ознайомлення з сервісом", ["1 пошуковий запит", "Telegram-сповіщення", "3 дні trial Pro"]),
    ("lite", "Lite", 3, 20000, 2000, 500, "Для перекупників-початківців", ["3 пошукові запити", "Швидкі сповіщення", "Ризик-оцінка"]),
    ("standard", "Стандарт", 10, 100000, 5000, 2000, "Для підбору одного авто", ["10 пошукових запитів", "Пріоритетні сповіщення", "Експорт CSV"]),
    ("pro", "Pro", 50, 500000, 10000, 6000, "Для професійних підбірників", ["50 пошукових запитів", "Миттєві сповіщення", "API доступ (незабаром)"]),
)
DEFAULT_PLAN = "free"
PLAN_SCHEMA = "id string, name string, searches_limit int, requests_month int, requests_hour int, price_uah int, description string, features array<string>"
PLAN_LABELS = {"free": "Безкоштовний", "lite": "Лайт", "standard": "Стандарт", "pro": "Про"}
SOURCE_LABELS = {"auto_ria": "AUTO.RIA", "olx": "OLX", "telegram": "Telegram"}
RISK_LABELS = {"low": "Брати", "medium": "Торгуватись", "high": "Пропустити"}
MEDIA_TYPES = {"png": "image/png", "webp": "image/webp", "gif": "image/gif"}
NOTIFICATION_TYPES = ("listing_match", "price_drop", "system")
#: Seconds to live of one-time codes and tokens.
TTL = {"code": 600, "reset": 3600, "oauth": 600, "connect": 900, "login": 900, "registration": 1800}
COOLDOWN_SECONDS, MAX_ATTEMPTS = 60, 5
WHOLE_COUNTRY = "Вся Україна"
#: Region -> lower-case keywords that place a listing there.
REGION_KEYWORDS = {
    "м. Київ": ["київ"],
    "Київська область": ["бровари", "біла церква", "ірпін", "буча", "фастів", "вишгород", "обухів"],
    "Вінницька область": ["вінниця", "жмеринка", "хмільник"],
    "Волинська область": ["луцьк", "ковель", "нововолинськ"],
    "Дніпропетровська область": ["дніпро", "дніпропетровськ", "кривий ріг", "кам'янське", "павлоград", "никополь"],
    "Донецька область": ["донецьк", "маріуполь", "краматорськ", "слов'янськ", "бахмут"],
    "Житомирська область": ["житомир", "бердичів", "коростень"],
    "Закарпатська область": ["ужгород", "мукачево", "хуст"],
    "Запорізька область": ["запоріжжя", "мелітополь", "бердянськ"],
    "Івано-Франківська область": ["івано-франківськ", "коломия", "калуш"],
    "Кіровоградська область": ["кропивницький", "кіровоград", "олександрія"],
    "Луганська область": ["луганськ", "северодонецьк", "альчевськ"],
    "Львівська область": ["львів", "дрогобич", "стрий", "червоноград"],
    "Миколаївська область": ["миколаїв", "первомайськ", "олешки"],
    "Одеська область": ["одеса", "ізмаїл", "чорноморськ"],
    "Полтавська область": ["полтава", "кременчук", "миргород"],
    "Рівненська область": ["рівне", "дубно", "острог"],
    "Сумська область": ["суми", "конотоп", "шостка"],
    "Тернопільська область": ["тернопіль", "чортків"],
    "Харківська область": ["харків"],
    "Херсонська область": ["херсон", "нова каховка"],
    "Хмельницька область": ["хмельницький", "кам'янець", "шепетівка"],
    "Черкаська область": ["черкаси", "умань"],
    "Чернівецька область": ["чернівці"],
    "Чернігівська область": ["чернігів", "ніжин", "прилуки"],
}
#: Export columns: key and header.
EXPORT_COLUMNS = (
    ("title", "Назва"), ("year", "Рік"), ("mileage", "Пробіг, км"), ("price", "Ціна, грн"), ("region", "Регіон"), ("fuel", "Паливо"),
    ("trans", "КПП"), ("src", "Джерело"), ("riskLabel", "Оцінка"), ("time", "Час"), ("desc", "Опис"), ("url", "Посилання"),
)
EXPORT_NUMBERS = ("year", "mileage", "price")
EXPORT_SHEET = "Оголошення"
#: Demo listings: external_id, source, title, brand, model, year, price, mileage, fuel, transmission, region, description, url.
DEMO_LISTINGS = (
    ("demo-001", "auto_ria", "Toyota Camry 2.5 AT", "Toyota", "Camry", 2021, 780000, 45000, "Бензин", "Автомат", "Київ", "Один власник, без ДТП.", "https://auto.ria.com/demo/1"),
    ("demo-002", "olx", "Volkswagen Passat B8 2.0 TDI", "Volkswagen", "Passat", 2019, 620000, 112000, "Дизель", "Автомат", "Львів", "Повна комплектація Highline.", "https://olx.ua/demo/2"),
    ("demo-003", "telegram", "Skoda Octavia A7 1.4 TSI", "Skoda", "Octavia", 2018, 485000, 98000, "Бензин", "Робот", "Одеса", "Торг доречний.", "https://t.me/demo/3"),
)
#: Client catalogue: id, brand, model, title, year, mileage, price, region, fuel, trans, src, risk, time, desc.
CATALOG = (
    ("1", "Toyota", "Camry", "Toyota Camry 2.5 AT", 2021, 45000, 780000, "Київ", "Бензин", "Автомат", "AUTO.RIA", "low", "12 хв тому", "Один власник, офіційний дилер. Без ДТП."),
    ("2", "Toyota", "Camry", "Toyota Camry 2.0 AT", 2019, 88000, 610000, "Київ", "Бензин", "Автомат", "Telegram", "medium", "34 хв тому", "Акуратна експлуатація. Торг доречний."),
    ("3", "Toyota", "Camry", "Toyota Camry 3.5 AT", 2022, 31000, 890000, "Харків", "Бензин", "Автомат", "OLX", "low", "1 год тому", "Максимальна комплектація, на гарантії."),
    ("4", "Toyota", "Camry", "Toyota Camry 2.5 Hybrid", 2020, 62000, 720000, "Одеса", "Гібрид", "Автомат", "AUTO.RIA", "medium", "3 год тому", "Економічний гібрид, сервісна книга."),
    ("5", "Volkswagen", "Passat", "Volkswagen Passat 2.0 TDI", 2019, 112000, 620000, "Львів", "Дизель", "Автомат", "OLX", "low", "5 год тому", "Highline, повна комплектація."),
    ("6", "Skoda", "Octavia", "Skoda Octavia 1.4 TSI", 2018, 98000, 485000, "Одеса", "Бензин", "Робот", "Telegram", "medium", "6 год тому", "Торг доречний, один власник."),
    ("7", "BMW", "3 Series", "BMW 320i xDrive", 2020, 54000, 950000, "Київ", "Бензин", "Автомат", "AUTO.RIA", "low", "8 год тому", "M Sport пакет, повна історія."),
    ("8", "Hyundai", "Sonata", "Hyundai Sonata 2.0", 2021, 41000, 680000, "Дніпро", "Бензин", "Автомат", "OLX", "low", "10 год тому", "Premium комплектація."),
    ("9", "Honda", "Accord", "Honda Accord 2.4", 2018, 105000, 520000, "Вінниця", "Бензин", "Автомат", "Telegram", "medium", "12 год тому", "Надійний седан, без ДТП."),
    ("10", "Toyota", "RAV4", "Toyota RAV4 2.5", 2023, 18000, 1150000, "Київ", "Бензин", "Автомат", "AUTO.RIA", "low", "15 хв тому", "Новий кросовер, повний привід."),
    ("11", "Nissan", "Leaf", "Nissan Leaf 40 kWh", 2019, 67000, 430000, "Львів", "Електро", "Автомат", "OLX", "medium", "1 дн тому", "Електромобіль, батарея 85%."),
    ("12", "Kia", "Sportage", "Kia Sportage 1.6 T-GDI", 2022, 35000, 820000, "Запоріжжя", "Бензин", "Автомат", "Telegram", "low", "2 дн тому", "GT Line, панорама."),
    ("13", "Toyota", "Camry", "Toyota Camry 2.5 MT", 2017, 125000, 480000, "Харків", "Бензин", "Механіка", "OLX", "high", "2 дн тому", "Бюджетний варіант для перепродажу."),
    ("14", "Mercedes-Benz", "C-Class", "Mercedes-Benz C 200", 2020, 58000, 980000, "Київ", "Бензин", "Автомат", "AUTO.RIA", "low", "3 дн тому", "AMG Line, дилерський пробіг."),
    ("15", "Renault", "Megane", "Renault Megane 1.5 dCi", 2018, 92000, 390000, "Одеса", "Дизель", "Механіка", "Telegram", "medium", "4 дн тому", "Економічний дизель."),
)


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, PLAN_SCHEMA)


def demo_listings(spark: SparkSession) -> DataFrame:
    """Demo rows with the defaults that an insert adds."""
    names = "external_id string, source string, title string, brand string, model string, year int, price int, mileage int, fuel string, transmission string, region string, description string, url string"
    return spark.createDataFrame(DEMO_LISTINGS, names).withColumns({"currency": F.lit("UAH"), "images": F.array().cast("array<string>"), "price_history": F.array().cast("array<int>"), "seller_type": F.lit("private"), "is_duplicate": F.lit(False)})


def catalog(spark: SparkSession) -> DataFrame:
    """Client catalogue with its input position."""
    rows = [(i, *r) for i, r in enumerate(CATALOG)]
    return spark.createDataFrame(rows, "pos int, id string, brand string, model string, title string, year int, mileage int, price int, region string, fuel string, trans string, src string, risk string, time string, desc string")


def region_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGION_KEYWORDS.items()), "region string, keywords array<string>")


def brand_models(spark: SparkSession, models: dict[str, list[str]]) -> DataFrame:
    """One row per brand and model of a catalogue given as a parameter, in its order."""
    rows = spark.createDataFrame(list(models.items()), "brand string, models array<string>")
    return rows.select("brand", F.posexplode("models").alias("pos", "model"))


def models_for_brand(models: DataFrame, brands: DataFrame) -> DataFrame:
    """(brand, models) of the brands asked for, models in their order; an unknown brand has none, an empty array."""
    held = models.groupBy("brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "model"))), lambda x: x["model"]).alias("models"))
    return brands.select("brand").join(held, "brand", "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A marketplace table by its declared schema; columns that older files lack read as null."""
    return spark.read.schema(getattr(schemas, name.upper())).parquet(path)

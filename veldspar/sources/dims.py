"""Small fixed tables: national statistics, financial indicators, indicator definitions, search phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# National statistics (indicator, value, unit, period, description).
STATISTICS = [
    ("population", 85372377.0, "kişi", "2023", "Türkiye nüfusu"), ("gdp", 1118.0, "milyar USD", "2023", "Gayri Safi Yurtiçi Hasıla"), ("gdp_per_capita", 13110.0, "USD", "2023", "Kişi başı GSYH"),
    ("inflation", 64.77, "%", "Aralık 2024", "TÜFE yıllık değişim"), ("unemployment", 8.8, "%", "2024 Q3", "İşsizlik oranı"), ("internet_users", 82.0, "%", "2024", "İnternet kullanım oranı"),
    ("smartphone_penetration", 77.0, "%", "2024", "Akıllı telefon penetrasyonu"), ("ecommerce_volume", 1850.0, "milyar TL", "2024", "E-ticaret hacmi"), ("household_count", 27500000.0, "hane", "2023", "Hane sayısı"),
    ("median_age", 33.5, "yaş", "2023", "Medyan yaş"), ("urbanization", 93.4, "%", "2023", "Kentleşme oranı"),
]
# Sectors (sector, measure, value).
SECTOR_DATA = [
    ("e_ticaret", "market_size_tl", 1.85e12), ("e_ticaret", "market_size_usd", 5.4e10), ("e_ticaret", "growth_rate", 35.0), ("e_ticaret", "user_count", 5.8e7), ("e_ticaret", "active_merchants", 6e5), ("e_ticaret", "average_basket", 850.0),
    ("fintech", "market_size_tl", 2.5e11), ("fintech", "transaction_volume", 2.5e12), ("fintech", "user_count", 4.5e7), ("fintech", "growth_rate", 45.0), ("saas", "market_size_tl", 1.5e10), ("saas", "growth_rate", 40.0),
    ("saas", "company_count", 1200.0), ("gaming", "market_size_tl", 4.5e10), ("gaming", "gamer_count", 4e7), ("gaming", "growth_rate", 25.0), ("logistics", "market_size_tl", 8.5e11), ("logistics", "growth_rate", 15.0),
]
# Cities (city, population, share of product in percent).
CITIES = [("istanbul", 15907951, 31.0), ("ankara", 5782285, 9.0), ("izmir", 4462056, 6.5), ("bursa", 3194720, 4.5), ("antalya", 2696249, 4.0)]
# Financial indicators (indicator, value, unit, description, date).
FINANCIAL = [
    ("usd_try", 34.50, "TL", "USD/TRY kuru", "2024-12"), ("eur_try", 36.20, "TL", "EUR/TRY kuru", "2024-12"), ("policy_rate", 50.0, "%", "Politika faizi", "2024-12"), ("deposit_rate", 45.0, "%", "Mevduat faizi (ortalama)", "2024-12"),
    ("credit_rate", 55.0, "%", "Kredi faizi (ortalama)", "2024-12"), ("cpi_annual", 64.77, "%", "TÜFE yıllık", "2024-12"), ("ppi_annual", 51.23, "%", "ÜFE yıllık", "2024-12"), ("m2_growth", 42.5, "%", "M2 para arzı büyümesi", "2024-12"),
    ("current_account", -45.2, "milyar USD", "Cari işlemler dengesi", "2024"), ("reserves", 98.5, "milyar USD", "Brüt döviz rezervi", "2024-12"),
]
# Credits in lira.
CREDITS = [("total_credits", 1.25e13), ("corporate_credits", 8.2e12), ("retail_credits", 4.3e12), ("credit_card_debt", 1.2e12), ("housing_credits", 8.5e11), ("vehicle_credits", 3.2e11), ("sme_credits", 2.1e12)]
# Indicators that a text provider is asked for (indicator, description, unit, category).
INDICATORS = [
    ("nufus", "Türkiye nüfusu", "milyon kişi", "demografi"), ("gsyih", "Türkiye GSYİH (Gayri Safi Yurtiçi Hasıla)", "milyar USD", "ekonomi"), ("gsyih_buyume", "Türkiye GSYİH büyüme oranı", "%", "ekonomi"),
    ("enflasyon", "Türkiye yıllık enflasyon oranı (TÜFE)", "%", "ekonomi"), ("issizlik", "Türkiye işsizlik oranı", "%", "istihdam"), ("dolar_kuru", "USD/TRY döviz kuru", "TL", "finans"), ("euro_kuru", "EUR/TRY döviz kuru", "TL", "finans"),
    ("faiz_orani", "TCMB politika faiz oranı", "%", "finans"), ("cari_denge", "Türkiye cari işlemler dengesi", "milyar USD", "ekonomi"), ("ihracat", "Türkiye yıllık ihracat", "milyar USD", "ticaret"), ("ithalat", "Türkiye yıllık ithalat", "milyar USD", "ticaret"),
]
EXCHANGE, NATIONAL, ECONOMIC = ("dolar_kuru", "euro_kuru"), ("nufus", "issizlik"), ("gsyih", "gsyih_buyume", "enflasyon", "faiz_orani", "cari_denge")
# Web search phrases by report type.
SEARCH_TEMPLATES = {
    "is_plani": ["{topic} pazar büyüklüğü Türkiye 2024", "{topic} sektör analizi rakipler", "{topic} iş modeli başarılı örnekler", "{topic} yatırım fırsatları Türkiye", "{topic} SWOT analizi sektör"],
    "pazar_analizi": ["{topic} pazar araştırması Türkiye 2024", "{topic} tüketici davranışları", "{topic} rekabet analizi lider şirketler", "{topic} büyüme trendleri"],
    "fizibilite": ["{topic} fizibilite çalışması", "{topic} maliyet analizi", "{topic} yatırım geri dönüş süresi", "{topic} risk faktörleri"],
    "default": ["{topic} Türkiye 2024", "{topic} sektör raporu", "{topic} istatistikler veriler"],
}


def statistics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATISTICS, "indicator string, value double, unit string, period string, description string")


def sectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTOR_DATA, "sector string, measure string, value double")


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CITIES, "city string, population long, gdp_share double")


def financial(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FINANCIAL, "indicator string, value double, unit string, description string, date string")


def credits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CREDITS, "kind string, value double")


def indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDICATORS, "indicator string, description string, unit string, category string")


def search_phrases(topics: DataFrame) -> DataFrame:
    """topics(topic, report_type) to (topic, report_type, n, phrase); unknown types take the default ones."""
    kinds = F.create_map(*[x for k, v in SEARCH_TEMPLATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    chosen = F.coalesce(kinds[F.col("report_type")], kinds[F.lit("default")])
    return topics.select("topic", "report_type", F.posexplode(chosen).alias("n", "t")).select("topic", "report_type", "n", F.replace("t", F.lit("{topic}"), F.col("topic")).alias("phrase"))


def scaled(value, unit):
    """A value in millions or thousands with one decimal, or with two as it is, and its unit."""
    short = lambda d, s: F.concat(F.format_number(value / d, 1), F.lit(s))
    return F.concat_ws(" ", F.when(value >= 1e6, short(1e6, "M")).when(value >= 1e3, short(1e3, "K")).otherwise(F.format_number(value, 2)), unit)


def statistics_table(spark: SparkSession) -> DataFrame:
    """The rows of the statistics as lines of a Markdown table."""
    return statistics(spark).select("indicator", F.concat(F.lit("| "), F.concat_ws(" | ", "description", scaled(F.col("value"), F.col("unit")), "period"), F.lit(" |")).alias("line"))


def convert(amounts: DataFrame, rate: float) -> DataFrame:
    """Amounts in lira to dollars and back, two decimals."""
    return amounts.select("*", F.bround(F.col("amount") / rate, 2).alias("usd"), F.bround(F.col("amount") * rate, 2).alias("tl"))

"""Dimension tables as plain rows. Every function takes its dimension as an argument; these are the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Indicator name, series, category, weight, impact, key indicator, by currency.
INDICATORS = {
    "USD": [
        ("CPI", "CPIAUCSL", "inflation", 1.5, "high", False),
        ("Core CPI", "CPILFESL", "inflation", 2.0, "high", True),
        ("PPI", "PPIFIS", "inflation", 1.2, "high", False),
        ("Core PPI", "PPIFES", "inflation", 1.5, "high", False),
        ("Core PCE", "PCEPILFE", "inflation", 2.0, "high", True),
        ("PCE", "PCEPI", "inflation", 1.3, "high", False),
        ("NFP", "PAYEMS", "labor_pos", 1.8, "high", True),
        ("Unemployment", "UNRATE", "labor_neg", 1.8, "high", False),
        ("Retail Sales", "RSAFS", "growth", 1.2, "high", False),
        ("GDP", "GDP", "growth", 1.5, "high", False),
        ("Interest Rate", "FEDFUNDS", "rate", 2.0, "high", True),
    ],
    "EUR": [
        ("CPI", "CP0000EZ19M086NEST", "inflation", 1.8, "high", True),
        ("Core CPI", "00XEFDEZ19M086NEST", "inflation", 2.0, "high", True),
        ("Production", "EA19PRINTO01IXOBSAM", "growth", 1.2, "medium", False),
        ("Unemployment", "LRHUTTTTEZM156S", "labor_neg", 1.5, "high", True),
        ("Interest Rate", "ECBDFR", "rate", 2.0, "high", True),
        ("GDP", "CLVMNACSCAB1GQEA19", "growth", 1.5, "high", False),
    ],
    "GBP": [
        ("CPI", "GBRCPIALLMINMEI", "inflation", 1.8, "high", True),
        ("Core CPI", "GBRCPICORMINMEI", "inflation", 2.0, "high", True),
        ("Production", "GBRPROINDMISMEI", "growth", 1.2, "medium", False),
        ("Unemployment", "LMUNRRTTGBM156S", "labor_neg", 1.5, "high", True),
        ("Interest Rate", "BOERUKM", "rate", 1.8, "high", True),
    ],
    "CAD": [
        ("CPI", "CANCPIALLMINMEI", "inflation", 1.8, "high", True),
        ("Core CPI", "CANCPICORMINMEI", "inflation", 2.0, "high", False),
        ("Employment", "LFEMTTTTCAM647S", "labor_pos", 1.5, "high", True),
        ("Unemployment", "LRUN64TTCAM156S", "labor_neg", 1.5, "high", True),
        ("Interest Rate", "IRSTCB01CAM156N", "rate", 1.8, "high", True),
    ],
    "JPY": [
        ("CPI", "JPNCPIALLMINMEI", "inflation", 1.8, "high", True),
        ("Core CPI", "JPNCPICORMINMEI", "inflation", 2.0, "high", True),
        ("Production", "JPNPROINDMISMEI", "growth", 1.2, "medium", True),
        ("Unemployment", "LRUN64TTJPM156S", "labor_neg", 1.5, "medium", False),
        ("Interest Rate", "IRSTCB01JPM156N", "rate", 2.0, "high", True),
    ],
    "CHF": [
        ("CPI", "CHECPIALLMINMEI", "inflation", 1.8, "high", True),
        ("Unemployment", "LRHUTTTTCHQ156S", "labor_neg", 1.5, "high", True),
        ("Interest Rate", "IRLTLT01CHM156N", "rate", 2.0, "high", True),
    ],
}

# Role, rank, series, offset.
FALLBACKS = [
    ("wti", 1, "DCOILWTICO", 0.0),
    ("wti", 2, "POILWTIUSDM", 0.0),
    ("wti", 3, "DCOILBRENTEU", 0.0),
    ("brent", 1, "DCOILBRENTEU", 0.0),
    ("brent", 2, "POILBREUSDM", 0.0),
]
OIL_OFFSET = 3.80

# Substrings of lower-cased titles and descriptions.
BULLISH = ["surge", "jump", "higher", "beat", "strong", "rally", "growth", "bull", "cut inflation", "options", "profit"]
BEARISH = ["drop", "fall", "lower", "miss", "weak", "slump", "bear", "inflation rise", "tension", "attacking", "military", "war"]
EMERGENCY = [
    "war", "attack", "missile", "middle east", "israel", "iran", "russia", "ukraine", "opec", "emergency", "crisis",
    "escalation", "sanction", "tariff", "threat", "strait", "explosion", "military", "ceasefire", "assassination", "nuclear",
]
STOP_WORDS = ["the", "a", "an", "in", "on", "of", "to", "for", "and", "is", "at", "by", "from", "as", "with", "news", "breaking", "update", "alert", "says", "report", "live"]
MOBILE_MARKS = ["iphone", "android", "ipad", "mobile", "ipod", "touch"]

# Assets with news points, and the report's assets with the words of their wires.
NEWS_ASSETS = ["USD", "EUR", "GBP", "CAD", "JPY", "AUD", "NZD", "CHF", "Gold", "Oil"]
WIRES = [
    ("Gold", ["gold", "xau", "middle east", "israel", "iran", "safe haven", "safe-haven", "war", "geopolitical"]),
    ("Oil", ["oil", "crude", "wti", "brent", "opec", "energy", "tanker", "red sea"]),
    ("USD", ["fed", "powell", "dollar", "usd", "fomc", "treasury", "inflation", "cpi", "nfp"]),
    ("EUR", ["ecb", "lagarde", "euro", "eur", "germany"]),
    ("GBP", ["boe", "bailey", "pound", "gbp", "bank of england"]),
    ("JPY", ["boj", "ueda", "yen", "jpy", "bank of japan"]),
    ("CAD", ["boc", "macklem", "cad", "loonie", "canada"]),
    ("AUD", ["rba", "bullock", "aud", "aussie", "australia"]),
    ("CHF", ["snb", "jordan", "chf", "franc", "swiss"]),
]

# Event code, currency, impact, day offset, clock, keywords.
EVENTS = [
    ("NZD_RETAIL", "NZD", "High", 3, "01:45", ["new zealand", "rbnz", "retail sales", "consumer spending", "dairy prices", "kiwi"]),
    ("NZD_RETAIL_HEADLINE", "NZD", "High", 3, "01:45", ["retail sales", "new zealand", "rbnz", "consumption", "household demand"]),
    ("CAD_PROFITS", "CAD", "Medium", 3, "15:30", ["corporate profits", "canada economy", "boc", "bank of canada", "crude oil canada", "wti"]),
    ("USD_BESSENT", "USD", "Medium", 3, "Tentative", ["bessent", "treasury", "us debt", "fiscal policy", "tariffs", "yields", "dollar strength", "bonds"]),
    ("AUD_CPI", "AUD", "High", 5, "04:30", ["australia cpi", "rba", "aussie inflation", "trimmed mean", "australia rates"]),
    ("US_PCE", "USD", "High", 5, "15:30", ["pce", "inflation", "fed inflation", "powell", "consumer spending", "sticky", "deflator"]),
    ("US_GDP", "USD", "High", 5, "15:30", ["gdp", "economic growth", "recession", "soft landing", "consumer spending", "output"]),
    ("US_DURABLE", "USD", "High", 5, "15:30", ["durable goods", "factory orders", "capex", "business spending", "manufacturing"]),
    ("US_SPENDING", "USD", "Medium", 5, "15:30", ["personal spending", "consumer spending", "income", "consumption"]),
    ("US_OIL_EIA", "USD", "High", 5, "17:30", ["crude oil", "eia", "inventories", "gasoline stockpiles", "wti", "brent", "oil build", "oil draw"]),
]

# Event code, series, its fallback, category, weight.
PRECURSORS = [
    ("NZD_RETAIL", "INDPRO", None, "growth", 0.5),
    ("NZD_RETAIL", "UMCSENT", None, "growth", 0.5),
    ("NZD_RETAIL_HEADLINE", "DSPIC96", None, "growth", 0.5),
    ("NZD_RETAIL_HEADLINE", "UMCSENT", None, "growth", 0.5),
    ("CAD_PROFITS", "DCOILWTICO", "POILWTIUSDM", "growth", 0.6),
    ("CAD_PROFITS", "INDPRO", None, "growth", 0.4),
    ("USD_BESSENT", "DFII10", None, "rate", 0.5),
    ("USD_BESSENT", "T10YIE", None, "inflation", 0.5),
    ("AUD_CPI", "INDPRO", None, "inflation", 0.5),
    ("AUD_CPI", "T10YIE", None, "inflation", 0.5),
    ("US_PCE", "PPIFES", None, "inflation", 0.4),
    ("US_PCE", "T10YIE", None, "inflation", 0.3),
    ("US_PCE", "DCOILWTICO", "POILWTIUSDM", "inflation", 0.3),
    ("US_GDP", "INDPRO", None, "growth", 0.4),
    ("US_GDP", "RSAFS", None, "growth", 0.35),
    ("US_GDP", "DSPIC96", None, "growth", 0.25),
    ("US_DURABLE", "INDPRO", None, "growth", 0.5),
    ("US_DURABLE", "PCEC96", None, "growth", 0.5),
    ("US_SPENDING", "DSPIC96", None, "growth", 0.5),
    ("US_SPENDING", "UMCSENT", None, "growth", 0.5),
    ("US_OIL_EIA", "DCOILWTICO", "POILWTIUSDM", "growth", 0.6),
    ("US_OIL_EIA", "INDPRO", None, "growth", 0.4),
]

# Lower bound, label, in the order of the test; thresholds are fixed values.
STRONG, MODERATE = 0.35, 0.15
LABELS = ("Strong Bullish", "Moderate Bullish", "Strong Bearish", "Moderate Bearish", "Neutral")


def indicator_dim(spark: SparkSession) -> DataFrame:
    rows = []
    for currency, several in INDICATORS.items():
        keys = [n for n, *_, is_key in several if is_key]
        rows += [(currency, k, n, s, cat, w, impact, is_key, keys.index(n) if is_key else None) for k, (n, s, cat, w, impact, is_key) in enumerate(several)]
    return spark.createDataFrame(rows, "currency string, ord int, indicator string, series_id string, cat string, weight double, impact string, is_key boolean, key_ord int")


def fallback_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FALLBACKS, "role string, rank int, series_id string, offset double")


def wire_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, k, w) for k, (a, w) in enumerate(WIRES)], "asset string, ord int, keywords array<string>")


def event_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, cur, i, k, d, t, w) for k, (c, cur, i, d, t, w) in enumerate(EVENTS)], "code string, currency string, impact string, template_ord int, day_offset int, time_str string, keywords array<string>")


def precursor_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRECURSORS, "code string, series_id string, fallback_id string, cat string, weight double")

# Weight and scale of the horizons mom, qoq, yoy, t3m and z.
HORIZON_WEIGHTS = ((0.30, 0.5), (0.25, 2.0), (0.25, 5.0), (0.10, 0.5), (0.10, 1.0))

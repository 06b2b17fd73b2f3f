"""Text and number cleaning as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder texts and units of metric strings. Fixed values.
NUMBER_BLANKS = ("", "N/A", "null", "None")
METRIC_BLANKS = ("", "N/A", "NA", "-", "--", "—", "–", "−")
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP"}
MULTIPLIERS = {"T": 1e12, "B": 1e9, "M": 1e6, "K": 1e3}
METRIC_TAGS = {
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Mkt. cap": "market_cap",
    "Avg. vol.": "avg_volume",
    "Volume": "volume",
    "Dividend": "dividend_yield",
    "Quarterly dividend": "quarterly_dividend",
    "Ex-dividend date": "ex_dividend_date",
    "P/E ratio": "pe_ratio",
    "52-wk high": "52_week_high",
    "52-wk low": "52_week_low",
    "EPS": "eps",
    "Beta": "beta",
    "Shares outstanding": "shares_outstanding",
    "No. of employees": "employees",
}
CURRENCY_LABELS = (
    "Open",
    "High",
    "Low",
    "Mkt. cap",
    "Quarterly dividend",
    "52-wk high",
    "52-wk low",
    "EPS",
)
SHARE_LABELS = ("Volume", "Avg. vol.", "Shares outstanding")
RATIO_LABELS = ("P/E ratio", "Beta")
DATE_PATTERNS = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd")


def safe_float(text: Column, default: float = 0.0) -> Column:
    """Number without thousands commas; blanks and unreadable text give the default."""
    clean = F.regexp_replace(F.trim(text.cast("string")), ",", "")
    value = F.when(~clean.isin(*NUMBER_BLANKS), clean.try_cast("double"))
    return F.coalesce(value, F.lit(default))


def clean_double(col: Column) -> Column:
    """Null in place of NaN."""
    return F.when(~F.isnan(col.cast("double")), col.cast("double"))


def normalize_cik(text: Column) -> Column:
    """Ten digits with leading zeros; null without any digit."""
    digits = F.regexp_replace(text.cast("string"), r"\D", "")
    trimmed = F.regexp_replace(digits, r"^0+(?=.)", "")
    return F.when(
        digits != "",
        F.when(F.length(trimmed) >= 10, trimmed).otherwise(F.lpad(trimmed, 10, "0")),
    )


def parse_date_text(text: Column) -> Column:
    """``yyyy-MM-dd`` from any of five spellings, else the text unchanged."""
    return F.coalesce(
        *[F.try_to_date(text, p).cast("string") for p in DATE_PATTERNS], text
    )


def metric_value(text: Column, label: Column) -> tuple[Column, Column]:
    """(value, unit) of a metric string such as ``$1.2T`` or ``3.4%``.

    The value is null when the text is a placeholder or not a number.
    """
    raw = F.trim(text)
    blank = raw.isNull() | F.upper(raw).isin(*METRIC_BLANKS)
    sign = F.substring(raw, 1, 1)
    has_sign = sign.isin(*CURRENCIES)
    body = F.when(has_sign, F.right(raw, F.length(raw) - 1)).otherwise(raw)
    currency = F.lit("USD")
    for mark, code in CURRENCIES.items():
        currency = F.when(sign == mark, code).otherwise(currency)
    percent = body.endswith("%")
    end = F.right(body, F.lit(1))
    scale = F.lit(1.0)
    for mark, factor in MULTIPLIERS.items():
        scale = F.when(end == mark, factor).otherwise(scale)
    scale = F.when(percent, 1.0).otherwise(scale)
    cut = percent | end.isin(*MULTIPLIERS)
    digits = F.when(cut, F.left(body, F.length(body) - 1)).otherwise(body)
    value = F.when(~blank, F.regexp_replace(digits, ",", "").try_cast("double") * scale)
    unit = (
        F.when(blank, "unknown")
        .when(percent, "percent")
        .when(value.isNull(), "unknown")
        .when(label.isin(*CURRENCY_LABELS), currency)
        .when(label.isin(*SHARE_LABELS), "shares")
        .when(label == "Dividend", "percent")
        .when(label == "No. of employees", "count")
        .when(label.isin(*RATIO_LABELS), "ratio")
        .otherwise("unknown")
    )
    return value, unit

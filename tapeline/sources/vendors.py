"""Vendor payload tables to channel records, one plan per landing table.

Inputs are DataFrames over landing files (text, CSV or JSON read by Spark). Outputs
carry the record fields of their channel; ``sinks.lake.lake_rows`` adds the layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.text import METRIC_TAGS, clean_double, metric_value, normalize_cik, parse_date_text, safe_float
from tapeline.functions.timefns import SECOND, micros_to_ns, ms_to_ns, ns_from_day, rfc3339_to_ns

# Known tapes and fiscal periods. Fixed values.
TAPES = ("A", "B", "C")
FISCAL_PERIODS = ("Q1", "Q2", "Q3", "Q4", "FY", "TTM")
FREQUENCIES = {"daily": "1d", "weekly": "1w", "monthly": "1mo", "annually": "1y"}


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _record(provider: str, symbol: Column, raw: Column, source_ts: Column, local_ts: Column) -> list[Column]:
    return [
        F.lit(provider).alias("provider"),
        symbol.alias("symbol"),
        raw.alias("symbol_raw"),
        source_ts.cast("long").alias("source_ts"),
        local_ts.cast("long").alias("local_ts"),
    ]


def _bar(interval: Column, o, h, l, c, v, vwap=None, count=None) -> list[Column]:
    return [
        interval.alias("interval"),
        o.cast("double").alias("open"),
        h.cast("double").alias("high"),
        l.cast("double").alias("low"),
        c.cast("double").alias("close"),
        v.cast("double").alias("volume"),
        (_null("double") if vwap is None else vwap.cast("double")).alias("vwap"),
        (_null("long") if count is None else count.cast("long")).alias("trade_count"),
    ]


# -- end-of-day files -------------------------------------------------------------

# Accepted header spellings of the end-of-day files. Fixed values.
EOD_HEADERS = {
    "date": ("<DATE>", "Date"),
    "open": ("<OPEN>", "Open"),
    "high": ("<HIGH>", "High"),
    "low": ("<LOW>", "Low"),
    "close": ("<CLOSE>", "Close"),
    "volume": ("<VOL>", "Volume", "<VOLUME>", "Vol"),
}


def read_eod_csv(spark: SparkSession, path: str) -> DataFrame:
    """EOD files with either header style as (symbol, date, open, ... volume) text.

    The symbol is the file name without its extension, upper-cased. Files of both
    styles may lie in one folder: every file is read by its own header line.
    """
    # file names come percent-encoded
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(path).select(
        F.upper(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)).alias("symbol"),
        F.col("_metadata.file_path").alias("_file"),
        F.split(F.regexp_replace("value", r"\r$", ""), ",").alias("_cells"),
    )
    head = F.transform("_cells", lambda c: F.upper(F.regexp_replace(F.trim(c), "[<>]", "")))
    named = F.array_contains(head, "DATE") & F.array_contains(head, "CLOSE")
    # one header per file: as many rows as there are files
    headers = lines.where(named).groupBy("_file").agg(F.first(head).alias("_head"))
    body = lines.where(~named).join(headers, "_file")

    def cell(name: str) -> Column:
        spellings = {s.strip("<>").upper() for s in EOD_HEADERS[name]}
        found = [F.get("_cells", F.array_position("_head", s).cast("int") - 1) for s in sorted(spellings)]
        return F.trim(F.coalesce(*found)).alias(name)

    return body.select("symbol", *[cell(c) for c in EOD_HEADERS])


def src_eod_csv(
    rows: DataFrame,
    *,
    provider: str = "stooq",
    start_ns: int = 0,
    end_ns: int = 9_223_372_036_854_775_807,
    local_ts: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(ohlcv bars, index values): symbols starting with ``^`` are indices.

    Dates are ``yyyy-MM-dd`` or ``yyyymmdd``; rows with an unreadable date are skipped
    and a missing volume is 0.
    """
    day = F.when(F.col("date").contains("-"), F.try_to_date(F.substring("date", 1, 10), "yyyy-MM-dd")).otherwise(
        F.try_to_date(F.substring("date", 1, 8), "yyyyMMdd")
    )
    ts = ns_from_day(day)
    typed = rows.withColumn("_ts", ts).where(F.col("_ts").between(start_ns, end_ns))
    index = F.col("symbol").startswith("^")
    common = _record(
        provider, F.col("symbol"), F.col("symbol"), F.col("_ts"), F.col("_ts") if local_ts is None else local_ts
    )

    def num(name: str) -> Column:
        return F.col(name).try_cast("double")

    volume = F.coalesce(num("volume"), F.lit(0.0)) if "volume" in rows.columns else F.lit(0.0)
    bars = typed.where(~index).select(
        *common, *_bar(F.lit("1d"), num("open"), num("high"), num("low"), num("close"), volume)
    )
    return bars, typed.where(index).select(*common, num("close").alias("value"))


def _action(rows: DataFrame, common: Sequence[Column], date: Column, kind: str, value: Column) -> DataFrame:
    return rows.select(
        *common, date.alias("ex_date"), F.lit(kind).alias("type"), value.cast("double").alias("value")
    )


def src_eod_json(
    payloads: DataFrame, *, provider: str = "tiingo", frequency: str = "daily", local_ts: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(bars, corporate actions) from ``ticker`` and a JSON array ``payload`` of EOD rows.

    A positive ``divCash`` is a cash dividend and a ``splitFactor`` other than 1 a split.
    """
    schema = (
        "array<struct<date string, open double, high double, low double, close double,"
        " volume double, divCash double, splitFactor double>>"
    )
    rows = payloads.select("ticker", F.inline(F.from_json("payload", schema)))
    source = rfc3339_to_ns(
        F.when(F.length("date") == 10, F.concat("date", F.lit("T00:00:00"))).otherwise(F.col("date"))
    )
    common = _record(
        provider, F.upper("ticker"), F.col("ticker"), source, source if local_ts is None else local_ts
    )
    interval = F.lit(FREQUENCIES.get(frequency.lower(), "1d"))
    bars = rows.select(*common, *_bar(interval, *[F.col(c) for c in ("open", "high", "low", "close", "volume")]))
    date = F.substring_index("date", "T", 1)
    cash = _action(rows.where(F.col("divCash") > 0), common, date, "dividend_cash", F.col("divCash"))
    split = _action(
        rows.where(F.abs(F.col("splitFactor") - 1.0) > 1e-9), common, date, "split", F.col("splitFactor")
    )
    return bars, cash.unionByName(split)


_FRAME = ("Open", "High", "Low", "Close", "Volume")


def src_eod_actions(
    frame: DataFrame, *, provider: str = "yahoo", local_ts: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(bars, corporate actions) from a price frame (symbol, ts, Open .. Volume,
    Dividends, Stock Splits). A row with a missing price or volume is skipped with its
    actions."""
    rows = frame.withColumns({c: clean_double(F.col(c)) for c in _FRAME}).dropna(subset=list(_FRAME))
    source = micros_to_ns(F.col("ts"))
    common = _record(
        provider, F.col("symbol"), F.col("symbol"), source, source if local_ts is None else local_ts
    )
    bars = rows.select(*common, *_bar(F.lit("1d"), *[F.col(c) for c in _FRAME]))
    date = F.date_format("ts", "yyyy-MM-dd")
    parts = [
        _action(rows.where(clean_double(F.col(name)) > 0), common, date, kind, F.col(name))
        for name, kind in (("Dividends", "dividend_cash"), ("Stock Splits", "split"))
        if name in frame.columns
    ]
    if not parts:
        return bars, _action(rows.limit(0), common, date, "split", _null("double"))
    return bars, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def src_intraday_bars(
    frame: DataFrame, interval: str, *, provider: str = "yahoo", local_ts: Column | None = None
) -> DataFrame:
    """Intraday price frame to bars; rows with a missing value are skipped."""
    rows = frame.withColumns({c: clean_double(F.col(c)) for c in _FRAME}).dropna(subset=list(_FRAME))
    source = micros_to_ns(F.col("ts"))
    common = _record(
        provider, F.col("symbol"), F.col("symbol"), source, source if local_ts is None else local_ts
    )
    return rows.select(*common, *_bar(F.lit(interval), *[F.col(c) for c in _FRAME]))


def src_option_chain(
    calls: DataFrame, puts: DataFrame, *, provider: str = "yahoo", local_ts: Column | None = None
) -> DataFrame:
    """Call and put frames to option quotes; a missing strike drops the row, NaN is null."""

    def side(frame: DataFrame, kind: str) -> DataFrame:
        num = {c: clean_double(F.col(c)) for c in ("strike", "bid", "ask", "lastPrice", "volume", "openInterest", "impliedVolatility")}
        rows = frame.withColumns(num).where(F.col("strike").isNotNull())
        source = micros_to_ns(F.col("lastTradeDate"))
        return rows.select(
            *_record(
                provider,
                F.col("contractSymbol"),
                F.col("contractSymbol"),
                source,
                source if local_ts is None else local_ts,
            ),
            "underlying",
            "expiry",
            "strike",
            F.lit(kind).alias("type"),
            "bid",
            "ask",
            F.col("lastPrice").alias("last"),
            "volume",
            F.col("openInterest").alias("open_interest"),
            F.col("impliedVolatility").alias("implied_volatility"),
            *[_null("double").alias(g) for g in ("delta", "gamma", "vega", "theta", "rho")],
        )

    return side(calls, "C").unionByName(side(puts, "P"))


# statement: (fiscal period or null for the quarter, form, covers a duration). Fixed values.
STATEMENTS = {
    "annual_financials": ("FY", "10-K", True),
    "quarterly_financials": (None, "10-Q", True),
    "annual_balance_sheet": ("FY", "10-K", False),
    "quarterly_balance_sheet": (None, "10-Q", False),
    "annual_cashflow": ("FY", "10-K", True),
    "quarterly_cashflow": (None, "10-Q", True),
}


def src_statements(
    matrices: dict[str, DataFrame], *, provider: str = "yahoo", local_ts: Column | None = None
) -> DataFrame:
    """Statement matrices (symbol, tag, one column per period end) to fundamental rows."""
    out = None
    for name, frame in matrices.items():
        period, form, lasting = STATEMENTS[name]
        ends = [c for c in frame.columns if c not in ("symbol", "tag")]
        long = frame.unpivot(["symbol", "tag"], ends, "_end", "_val")
        val = clean_double(F.col("_val"))
        day = F.try_to_date(F.substring("_end", 1, 10))
        fp = F.lit(period) if period else F.concat(F.lit("Q"), F.quarter(day).cast("string"))
        back = 12 if period == "FY" else 3
        source = ns_from_day(day)
        rows = long.where(val.isNotNull() & day.isNotNull()).select(
            *_record(provider, F.col("symbol"), F.col("symbol"), source, source if local_ts is None else local_ts),
            F.lit(provider).alias("taxonomy"),
            "tag",
            F.lit("USD").alias("unit"),
            val.alias("val"),
            day.cast("string").alias("end"),
            (F.add_months(day, -back).cast("string") if lasting else _null("string")).alias("start"),
            F.year(day).cast("long").alias("fy"),
            fp.alias("fp"),
            F.lit(form).alias("form"),
            *[_null("string").alias(c) for c in ("filed", "accn", "frame")],
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no statements given")
    return out


def src_insider(
    frame: DataFrame, *, provider: str = "yahoo", local_ts: Column | None = None
) -> DataFrame:
    """Insider transactions; rows without name, type or date are skipped."""

    def text(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit(""))

    shares, value = clean_double(F.col("Shares")), clean_double(F.col("Value"))
    rows = frame.where(
        text("Insider").isNotNull() & text("Transaction").isNotNull() & F.col("Start Date").isNotNull()
    )
    return rows.select(
        *_record(
            provider,
            F.col("symbol"),
            F.col("symbol"),
            _null("long"),
            _null("long") if local_ts is None else local_ts,
        ),
        text("Insider").alias("insider_name"),
        F.coalesce(text("Position"), F.lit("Unknown")).alias("position"),
        text("Transaction").alias("transaction_type"),
        F.date_format("Start Date", "yyyy-MM-dd").alias("transaction_date"),
        shares.alias("shares"),
        F.when(shares > 0, F.try_divide(value, shares)).alias("price"),
        value.alias("value"),
        text("Ownership").alias("ownership"),
    )


# -- filings and facts ------------------------------------------------------------

_FACT = (
    "struct<val string, end string, start string, fy long, fp string, form string,"
    " filed string, accn string, frame string>"
)
FACTS_SCHEMA = f"struct<facts map<string, map<string, struct<units map<string, array<{_FACT}>>>>>>"


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    """(cik, payload) from a folder of ``CIK##########.json`` files."""
    name = F.regexp_replace(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1), "CIK", "")
    files = spark.read.option("wholetext", True).text(path)
    return files.select(name.try_cast("long").alias("cik"), F.col("value").alias("payload")).where(
        F.col("cik").isNotNull()
    )


def src_company_facts(
    payloads: DataFrame,
    tickers: DataFrame | None = None,
    *,
    provider: str = "sec_edgar",
    local_ts: Column | None = None,
) -> DataFrame:
    """Nested company facts (cik, payload) to fundamental rows, with ``ord`` = place in the file.

    An unreadable file gives no rows and an unreadable number is 0. ``tickers`` (cik,
    symbol) names the company; without an entry it is ``CIK`` and ten digits.
    """
    if tickers is not None:
        named = tickers.select(F.col("cik").cast("long").alias("cik"), F.col("symbol").alias("_sym"))
        payloads = payloads.join(named, "cik", "left")
    else:
        payloads = payloads.withColumn("_sym", _null("string"))
    # the company is named once per payload, before its facts multiply
    own = F.coalesce("_sym", F.concat(F.lit("CIK"), normalize_cik(F.col("cik").cast("string"))))
    parsed = payloads.select(own.alias("_sym"), F.from_json("payload", FACTS_SCHEMA).alias("_p"))
    taxa = parsed.select("_sym", F.posexplode("_p.facts").alias("_o1", "taxonomy", "_tags"))
    tags = taxa.select("_sym", "_o1", "taxonomy", F.posexplode("_tags").alias("_o2", "tag", "_t"))
    units = tags.select("_sym", "_o1", "_o2", "taxonomy", "tag", F.posexplode("_t.units").alias("_o3", "unit", "_v"))
    facts = units.select(
        "_sym", "_o1", "_o2", "_o3", "taxonomy", "tag", "unit", F.posexplode("_v").alias("_o4", "_f")
    )
    symbol = F.col("_sym")
    fp = F.when(F.col("_f.fp").isin(*FISCAL_PERIODS), F.col("_f.fp"))
    return facts.select(
        *_record(provider, symbol, symbol, _null("long"), F.lit(0) if local_ts is None else local_ts),
        "taxonomy",
        "tag",
        "unit",
        F.coalesce(F.col("_f.val").try_cast("double"), F.lit(0.0)).alias("val"),
        F.coalesce("_f.end", F.lit("")).alias("end"),
        F.col("_f.start").alias("start"),
        F.col("_f.fy").alias("fy"),
        fp.alias("fp"),
        *[F.col(f"_f.{c}").alias(c) for c in ("form", "filed", "accn", "frame")],
        # place in the file: the first of equal facts wins later on
        F.array("_o1", "_o2", "_o3", "_o4").alias("ord"),
    )


FILINGS_SCHEMA = (
    "struct<accessionNumber array<string>, form array<string>, filingDate array<string>,"
    " reportDate array<string>, primaryDocument array<string>, isXBRL array<int>>"
)
# Where filing documents lie. Fixed value.
DOCUMENT_ROOT = "https://www.sec.gov/Archives/edgar/data"


def src_filings(
    payloads: DataFrame, *, provider: str = "sec_edgar", local_ts: Column | None = None
) -> DataFrame:
    """Columnar filing arrays (symbol, cik, payload) to filing rows; short arrays are padded."""
    parsed = payloads.select("symbol", "cik", F.from_json("payload", FILINGS_SCHEMA).alias("_p"))
    names = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "isXBRL"]
    rows = parsed.select(
        "symbol", "cik", F.inline(F.arrays_zip(*[F.coalesce(F.col(f"_p.{n}"), F.array()).alias(n) for n in names]))
    ).where(F.col("accessionNumber").isNotNull())
    doc = F.coalesce("primaryDocument", F.lit(""))
    url = F.when(
        doc != "",
        F.concat_ws(
            "/",
            F.lit(DOCUMENT_ROOT),
            F.col("cik").cast("string"),
            F.replace("accessionNumber", F.lit("-"), F.lit("")),
            doc,
        ),
    ).otherwise("")
    return rows.select(
        *_record(
            provider, F.col("symbol"), F.col("symbol"), _null("long"), F.lit(0) if local_ts is None else local_ts
        ),
        F.col("accessionNumber").alias("accession_number"),
        F.coalesce("form", F.lit("")).alias("form"),
        F.coalesce("filingDate", F.lit("")).alias("filing_date"),
        doc.alias("primary_document"),
        url.alias("document_url"),
        F.col("reportDate").alias("report_date"),
        (F.col("isXBRL") != 0).alias("is_xbrl"),
    )


def src_ticker_map(payloads: DataFrame) -> DataFrame:
    """(cik, ticker, ord, is_primary) from JSON objects of {cik_str, ticker} entries.

    The first ticker of a company is its primary one.
    """
    schema = "map<string, struct<cik_str long, ticker string>>"
    rows = payloads.select(F.posexplode(F.from_json("payload", schema)).alias("ord", "_k", "_v")).select(
        F.col("_v.cik_str").alias("cik"), F.upper("_v.ticker").alias("ticker"), "ord"
    )
    first = rows.groupBy("cik").agg(F.min(F.struct("ord", "ticker")).alias("_f"))
    return rows.join(first, "cik").select(
        "cik", "ticker", "ord", ((F.col("_f.ord") == F.col("ord")) & (F.col("_f.ticker") == F.col("ticker"))).alias("is_primary")
    )


UNIVERSE_SCHEMA = "ticker string, exchange string, assetType string, priceCurrency string, startDate string, endDate string"


def src_ticker_universe(spark: SparkSession, path: str) -> DataFrame:
    """Supported-tickers CSV, tickers upper-cased."""
    df = spark.read.option("header", True).schema(UNIVERSE_SCHEMA).csv(path)
    return df.withColumn("ticker", F.upper("ticker"))


# Optional qualifiers of an identifier mapping request. Fixed values.
QUALIFIERS = ("exch_code", "mic_code", "currency", "market_sec_des")


def src_identifier_map(jobs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply an identifier mapping table to jobs: one row per job and answer.

    ``jobs``: ord, id_type, id_value and optional qualifiers; ``mapping`` has the same
    keys plus the record fields. A qualifier left out matches only entries without it.
    A job without an answer keeps one row with null fields; ``ord`` keeps the order.
    """
    keys = ["id_type", "id_value", *QUALIFIERS]
    fields = [c for c in mapping.columns if c not in keys]
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"j.{key}").eqNullSafe(F.col(f"a.{key}"))
    return (
        jobs.alias("j")
        .join(mapping.alias("a"), on, "left")
        .select("j.ord", *[f"j.{k}" for k in keys], *[f"a.{c}" for c in fields])
    )


# -- message frames ---------------------------------------------------------------

#: Names of a message item by their JSON names, which differ only in case (``S`` symbol, ``s`` size).
_ITEM = {
    "T": "kind", "S": "symbol", "t": "at", "i": "id", "p": "price", "s": "size", "c": "c", "z": "tape", "x": "venue",
    "bp": "bid_px", "bs": "bid_sz", "ap": "ask_px", "as": "ask_sz",
    "o": "open", "h": "high", "l": "low", "v": "volume", "vw": "vwap", "n": "count",
}


def trade_quote_bar_records(
    frames: DataFrame, *, provider: str = "alpaca", consolidated: bool = False
) -> DataFrame:
    """JSON frame arrays (local_ts, payload) to one table of trade, quote and bar records:
    their ``channel`` and the columns of all three, null where a channel has none.

    An unknown tape reads ``unknown``; an item without symbol, time or a needed number
    is skipped and leaves the rest of its frame. Items are read as text, since ``c`` is a
    list in trades and quotes but the close in bars.
    """
    read = ", ".join(f"`{name}`: string" for name in _ITEM)
    named = ", ".join(f"`{name}`: string" for name in _ITEM.values())
    parsed = F.from_json("payload", f"array<struct<{read}>>").cast(f"array<struct<{named}>>")
    items = frames.select("local_ts", F.explode(parsed).alias("_i"))

    def text(name: str) -> Column:
        return F.col(f"_i.{name}")

    def num(name: str) -> Column:
        return text(name).try_cast("double")

    def having(kind: str, *needed: str) -> Column:
        ok = text("kind") == kind
        for name in needed:
            ok = ok & num(name).isNotNull()
        return ok

    source = rfc3339_to_ns(text("at"))
    kinds = {
        "trade": having("t", "price", "size"),
        "quote": having("q", "bid_px", "bid_sz", "ask_px", "ask_sz"),
        "bar": having("b", "open", "high", "low", "c", "volume"),
    }
    items = items.where(text("symbol").isNotNull() & (kinds["trade"] | kinds["quote"] | kinds["bar"]))
    items = items.where(source.isNotNull())
    trade, quote, bar = (text("kind") == kind for kind in ("t", "q", "b"))
    tape = F.when(text("tape").isin(*TAPES), text("tape")).otherwise("unknown")
    bars = _bar(
        F.lit("1m"),
        num("open"),
        num("high"),
        num("low"),
        num("c"),
        num("volume"),
        num("vwap"),
        text("count").try_cast("long"),
    )
    return items.select(
        F.when(trade, "trade").when(quote, "quote").otherwise("bar").alias("channel"),
        *_record(provider, text("symbol"), text("symbol"), source, F.col("local_ts")),
        F.when(trade, F.coalesce(text("id"), F.lit(""))).alias("id"),
        F.when(trade, num("price")).alias("price"),
        F.when(trade, num("size")).alias("size"),
        *[F.when(quote, num(name)).alias(name) for name in ("bid_px", "bid_sz", "ask_px", "ask_sz")],
        F.when(quote, F.lit(False)).alias("is_nbbo"),
        F.when(quote, F.lit(consolidated)).alias("is_consolidated"),
        F.when(~bar, F.from_json(text("c"), "array<string>")).alias("conditions"),
        F.when(~bar, tape).alias("tape"),
        F.when(trade, text("venue")).alias("venue"),
        F.when(bar, F.struct(*bars)).alias("_bar"),
    ).select("*", "_bar.*").drop("_bar")


def src_trade_quote_bar_frames(
    frames: DataFrame, *, provider: str = "alpaca", consolidated: bool = False
) -> dict[str, DataFrame]:
    """The trade, quote and bar records of ``trade_quote_bar_records`` as a table each."""
    records = trade_quote_bar_records(frames, provider=provider, consolidated=consolidated)
    common = ["provider", "symbol", "symbol_raw", "source_ts", "local_ts"]
    quote = ["bid_px", "bid_sz", "ask_px", "ask_sz", "is_nbbo", "is_consolidated", "conditions", "tape"]
    own = {
        "trade": ["id", "price", "size", "conditions", "tape", "venue"],
        "quote": quote,
        "bar": records.columns[records.columns.index("venue") + 1 :],
    }
    return {c: records.where(F.col("channel") == c).select(*common, *names) for c, names in own.items()}


def src_trade_frames(frames: DataFrame, *, provider: str = "finnhub") -> DataFrame:
    """``{"type": "trade", "data": [...]}`` frames to trades; other frames are ignored."""
    schema = "struct<type string, data array<struct<s string, p double, v double, t long, c array<string>>>>"
    items = (
        frames.select("local_ts", F.from_json("payload", schema).alias("_m"))
        .where(F.col("_m.type") == "trade")
        .select("local_ts", F.inline("_m.data"))
        .where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("v").isNotNull())
    )
    return items.select(
        *_record(provider, F.col("s"), F.col("s"), ms_to_ns(F.col("t")), F.col("local_ts")),
        F.lit("").alias("id"),
        F.col("p").alias("price"),
        F.col("v").alias("size"),
        F.col("c").alias("conditions"),
        _null("string").alias("tape"),
        _null("string").alias("venue"),
    )


# -- chart series and text fields -------------------------------------------------

# Longest median spacing in seconds of each interval label. Fixed values.
SPACING = [
    (90.0, "1m"),
    (350.0, "5m"),
    (1000.0, "15m"),
    (2000.0, "30m"),
    (4000.0, "1h"),
    (2.5 * 86_400, "1d"),
    (8.0 * 86_400, "1w"),
]
# Chart types whose interval is known. Fixed values.
CHART_INTERVALS = {"5D": "15m", "1M": "1h", "1Y": "1d", "5Y": "1d", "All": "1d"}
LONGEST_GAP = 4.5 * 86_400


def chart_interval(chart_type: Column, stamps: Column) -> Column:
    """Interval label: from the chart type, else from the median of the first eleven
    gaps of at most 4.5 days, else ``1d``."""
    head = F.transform(F.slice(stamps, 1, 12), lambda t: rfc3339_to_ns(t))
    gaps = F.transform(
        F.filter(
            F.zip_with(F.slice(head, 2, 12), head, lambda b, a: F.abs(b - a) / float(SECOND)),
            lambda g: g.isNotNull() & (g <= LONGEST_GAP),
        ),
        lambda g: g,
    )
    ordered = F.array_sort(gaps)
    median = F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))
    label = F.when(median.isNotNull(), "1mo").otherwise("1d")
    for limit, name in reversed(SPACING):
        label = F.when(median <= limit, name).otherwise(label)
    known = F.lit(None).cast("string")
    for chart, name in CHART_INTERVALS.items():
        known = F.when(chart_type == chart, name).otherwise(known)
    return F.coalesce(known, label)


SERIES_SCHEMA = (
    "struct<timeStamps array<string>, openPrices array<string>, prices array<string>,"
    " pricesHigh array<string>, pricesLow array<string>, volumes array<string>>"
)


def src_chart_series(
    charts: DataFrame,
    *,
    provider: str = "msn_money",
    start_ns: int = 0,
    end_ns: int = 9_223_372_036_854_775_807,
    local_ts: Column | None = None,
) -> DataFrame:
    """Parallel-array chart series (symbol, chart_type, payload) to bars.

    A value missing from its array is 0. Rows with a readable time outside the range
    are skipped.
    """
    parsed = charts.select("symbol", "chart_type", F.from_json("payload", SERIES_SCHEMA).alias("_s"))
    parsed = parsed.withColumn("_interval", chart_interval(F.col("chart_type"), F.col("_s.timeStamps")))
    rows = parsed.select("*", F.posexplode("_s.timeStamps").alias("_i", "_t"))
    source = rfc3339_to_ns(F.col("_t"))

    def at(name: str) -> Column:
        return safe_float(F.get(F.col(f"_s.{name}"), F.col("_i")))

    return rows.where(source.isNull() | source.between(start_ns, end_ns)).select(
        *_record(
            provider, F.upper("symbol"), F.col("symbol"), source, source if local_ts is None else local_ts
        ),
        *_bar(
            F.col("_interval"), at("openPrices"), at("pricesHigh"), at("pricesLow"), at("prices"), at("volumes")
        ),
    )


def split_ratio(text: Column) -> Column:
    """``4:1`` -> 4.0; an unreadable or zero second part leaves the first."""
    parts = F.split(text, ":")
    first, second = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(text.contains(":"), F.coalesce(F.try_divide(first, second), first)).otherwise(
        text.try_cast("double")
    )


def src_split_text(
    stats: DataFrame,
    *,
    provider: str = "msn_money",
    start_ns: int = 0,
    end_ns: int = 9_223_372_036_854_775_807,
    local_ts: Column | None = None,
) -> DataFrame:
    """Dividend and split text fields (symbol, exDividendAmount, exDividendDate,
    lastSplitFactor, lastSplitDate) to corporate actions."""

    def part(kind: str, date: str, text: str, value: Column) -> DataFrame:
        ex = F.substring_index(F.col(date), "T", 1)
        ts = ns_from_day(F.try_to_date(ex, "yyyy-MM-dd"))
        some = (F.col(text) != "") & (F.col(date) != "")
        rows = stats.withColumns({"_ex": ex, "_ts": ts, "_val": value}).where(
            some & F.col("_ts").between(start_ns, end_ns) & F.col("_val").isNotNull()
        )
        common = _record(
            provider, F.upper("symbol"), F.col("symbol"), F.col("_ts"), F.col("_ts") if local_ts is None else local_ts
        )
        return _action(rows, common, F.col("_ex"), kind, F.col("_val"))

    cash = part("dividend_cash", "exDividendDate", "exDividendAmount", safe_float(F.col("exDividendAmount")))
    split = part("split", "lastSplitDate", "lastSplitFactor", split_ratio(F.col("lastSplitFactor")))
    return cash.unionByName(split)


def src_metric_text(
    metrics: DataFrame, *, provider: str = "google_finance", local_ts: Column | None = None
) -> DataFrame:
    """Labelled metric strings (symbol, label, text) to fundamental rows.

    Unknown labels and missing values give no row; the ex-dividend date goes to ``end``.
    """
    label, text = F.col("label"), F.trim("text")
    tag = F.lit(None).cast("string")
    for name, mapped in METRIC_TAGS.items():
        tag = F.when(label == name, mapped).otherwise(tag)
    value, unit = metric_value(text, label)
    dated = label == "Ex-dividend date"
    rows = metrics.withColumns(
        {
            "_tag": tag,
            "_val": F.when(dated, F.lit(0.0)).otherwise(value),
            "_unit": F.when(dated, "date").otherwise(unit),
            "_end": F.when(dated, parse_date_text(text)).otherwise(""),
        }
    ).where(F.col("_tag").isNotNull() & F.col("_val").isNotNull())
    return rows.select(
        *_record(
            provider, F.upper("symbol"), F.col("symbol"), _null("long"), F.lit(0) if local_ts is None else local_ts
        ),
        F.lit(provider).alias("taxonomy"),
        F.col("_tag").alias("tag"),
        F.col("_unit").alias("unit"),
        F.col("_val").alias("val"),
        F.col("_end").alias("end"),
    )



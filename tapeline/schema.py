"""Column layout of every channel table. The on-disk format."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INTEGER = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, BOOLEAN, STRINGS = T.DoubleType(), T.BooleanType(), T.ArrayType(T.StringType())
# Scaled on-chain indices exceed 64 bits.
INDEX = T.DecimalType(38, 0)
LEVEL = T.StructType([T.StructField("price", DOUBLE), T.StructField("size", DOUBLE)])
LEVELS = T.ArrayType(LEVEL)

# What a record carries on its own, before the layout columns are derived.
RECORD_FIELDS = [
    T.StructField("provider", STRING),
    T.StructField("symbol", STRING),
    T.StructField("symbol_raw", STRING),
    T.StructField("source_ts", LONG),
    T.StructField("local_ts", LONG),
]
LAYOUT_FIELDS = [
    T.StructField("channel", STRING),
    T.StructField("date", STRING),
    T.StructField("bucket", INTEGER),
    T.StructField("exchange", STRING),
]
PARTITION_COLUMNS = ["provider", "channel", "date", "bucket"]

EXTRA: dict[str, list[T.StructField]] = {
    "trade": [
        T.StructField("id", STRING),
        T.StructField("price", DOUBLE),
        T.StructField("size", DOUBLE),
        T.StructField("conditions", STRINGS),
        T.StructField("tape", STRING),
        T.StructField("venue", STRING),
    ],
    "quote": [
        T.StructField("bid_px", DOUBLE),
        T.StructField("bid_sz", DOUBLE),
        T.StructField("ask_px", DOUBLE),
        T.StructField("ask_sz", DOUBLE),
        T.StructField("is_nbbo", BOOLEAN),
        T.StructField("is_consolidated", BOOLEAN),
        T.StructField("conditions", STRINGS),
        T.StructField("tape", STRING),
    ],
    "book_snapshot": [
        T.StructField("bids", LEVELS),
        T.StructField("asks", LEVELS),
        T.StructField("depth", LONG),
        T.StructField("sequence_id", LONG),
        T.StructField("is_snapshot", BOOLEAN),
    ],
    "book_delta": [
        T.StructField("bids", LEVELS),
        T.StructField("asks", LEVELS),
        T.StructField("seq_id", LONG),
        T.StructField("prev_seq_id", LONG),
        T.StructField("is_snapshot", BOOLEAN),
    ],
    "depth": [
        T.StructField("bids", LEVELS),
        T.StructField("asks", LEVELS),
        T.StructField("reference_price", DOUBLE),
        T.StructField("basis", STRING),
        T.StructField("is_synthetic", BOOLEAN),
        T.StructField("depth", LONG),
    ],
    "bar": [
        T.StructField("interval", STRING),
        T.StructField("open", DOUBLE),
        T.StructField("high", DOUBLE),
        T.StructField("low", DOUBLE),
        T.StructField("close", DOUBLE),
        T.StructField("volume", DOUBLE),
        T.StructField("vwap", DOUBLE),
        T.StructField("trade_count", LONG),
    ],
    "corp_action": [
        T.StructField("ex_date", STRING),
        T.StructField("type", STRING),
        T.StructField("value", DOUBLE),
    ],
    "fundamental": [
        T.StructField("taxonomy", STRING),
        T.StructField("tag", STRING),
        T.StructField("unit", STRING),
        T.StructField("val", DOUBLE),
        T.StructField("end", STRING),
        T.StructField("start", STRING),
        T.StructField("fy", LONG),
        T.StructField("fp", STRING),
        T.StructField("form", STRING),
        T.StructField("filed", STRING),
        T.StructField("accn", STRING),
        T.StructField("frame", STRING),
    ],
    "filing": [
        T.StructField("accession_number", STRING),
        T.StructField("form", STRING),
        T.StructField("filing_date", STRING),
        T.StructField("primary_document", STRING),
        T.StructField("document_url", STRING),
        T.StructField("report_date", STRING),
        T.StructField("is_xbrl", BOOLEAN),
    ],
    "ohlcv": [
        T.StructField("interval", STRING),
        T.StructField("open", DOUBLE),
        T.StructField("high", DOUBLE),
        T.StructField("low", DOUBLE),
        T.StructField("close", DOUBLE),
        T.StructField("volume", DOUBLE),
        T.StructField("vwap", DOUBLE),
        T.StructField("trade_count", LONG),
    ],
    "index_value": [
        T.StructField("value", DOUBLE),
    ],
    "auction": [
        T.StructField("paired_shares", DOUBLE),
        T.StructField("imbalance_shares", DOUBLE),
        T.StructField("imbalance_side", STRING),
        T.StructField("reference_price", DOUBLE),
        T.StructField("indicative_price", DOUBLE),
        T.StructField("auction_type", STRING),
    ],
    "trading_status": [
        T.StructField("status", STRING),
        T.StructField("reason", STRING),
        T.StructField("limit_up_price", DOUBLE),
        T.StructField("limit_down_price", DOUBLE),
        T.StructField("indicator", STRING),
    ],
    "instrument": [
        T.StructField("name", STRING),
        T.StructField("cik", STRING),
        T.StructField("figi", STRING),
        T.StructField("composite_figi", STRING),
        T.StructField("share_class_figi", STRING),
        T.StructField("cusip", STRING),
        T.StructField("exchange_name", STRING),
        T.StructField("security_type", STRING),
        T.StructField("sic", STRING),
        T.StructField("shares_outstanding", LONG),
        T.StructField("listing_date", STRING),
        T.StructField("status", STRING),
    ],
    "insider": [
        T.StructField("insider_name", STRING),
        T.StructField("position", STRING),
        T.StructField("transaction_type", STRING),
        T.StructField("transaction_date", STRING),
        T.StructField("shares", DOUBLE),
        T.StructField("price", DOUBLE),
        T.StructField("value", DOUBLE),
        T.StructField("ownership", STRING),
    ],
    "holding_13f": [
        T.StructField("manager_name", STRING),
        T.StructField("issuer_name", STRING),
        T.StructField("cusip", STRING),
        T.StructField("value", DOUBLE),
        T.StructField("shares", DOUBLE),
        T.StructField("shares_type", STRING),
        T.StructField("discretion", STRING),
        T.StructField("voting_sole", DOUBLE),
        T.StructField("voting_shared", DOUBLE),
        T.StructField("voting_none", DOUBLE),
        T.StructField("report_date", STRING),
        T.StructField("accession_number", STRING),
    ],
    "short_interest": [
        T.StructField("settlement_date", STRING),
        T.StructField("short_interest", DOUBLE),
        T.StructField("prev_short_interest", DOUBLE),
        T.StructField("days_to_cover", DOUBLE),
        T.StructField("change_pct", DOUBLE),
    ],
    "short_volume": [
        T.StructField("date_val", STRING),
        T.StructField("short_volume", DOUBLE),
        T.StructField("short_exempt_volume", DOUBLE),
        T.StructField("total_volume", DOUBLE),
    ],
    "option_quote": [
        T.StructField("underlying", STRING),
        T.StructField("expiry", STRING),
        T.StructField("strike", DOUBLE),
        T.StructField("type", STRING),
        T.StructField("bid", DOUBLE),
        T.StructField("ask", DOUBLE),
        T.StructField("last", DOUBLE),
        T.StructField("volume", DOUBLE),
        T.StructField("open_interest", DOUBLE),
        T.StructField("implied_volatility", DOUBLE),
        T.StructField("delta", DOUBLE),
        T.StructField("gamma", DOUBLE),
        T.StructField("vega", DOUBLE),
        T.StructField("theta", DOUBLE),
        T.StructField("rho", DOUBLE),
    ],
    "macro_series": [
        T.StructField("date_val", STRING),
        T.StructField("value", DOUBLE),
        T.StructField("realtime_start", STRING),
        T.StructField("realtime_end", STRING),
    ],
    "reserve_data_updated": [
        T.StructField("exchange_ts", LONG),
        T.StructField("reserve", STRING),
        T.StructField("liquidity_rate", DOUBLE),
        T.StructField("stable_borrow_rate", DOUBLE),
        T.StructField("variable_borrow_rate", DOUBLE),
        T.StructField("liquidity_index", INDEX),
        T.StructField("variable_borrow_index", INDEX),
    ],
    "liquidation_call": [
        T.StructField("exchange_ts", LONG),
        T.StructField("collateral_asset", STRING),
        T.StructField("debt_asset", STRING),
        T.StructField("user", STRING),
        T.StructField("debt_to_cover", DOUBLE),
        T.StructField("liquidated_collateral_amount", DOUBLE),
        T.StructField("liquidator", STRING),
        T.StructField("receive_a_token", BOOLEAN),
    ],
    "limit_order_fill": [
        T.StructField("exchange_ts", LONG),
        T.StructField("tx_hash", STRING),
        T.StructField("log_index", LONG),
        T.StructField("protocol", STRING),
        T.StructField("maker", STRING),
        T.StructField("taker", STRING),
        T.StructField("maker_token", STRING),
        T.StructField("taker_token", STRING),
        T.StructField("maker_amount", DOUBLE),
        T.StructField("taker_amount", DOUBLE),
        T.StructField("order_hash", STRING),
    ],
    "balance_correction": [
        T.StructField("exchange_ts", LONG),
        T.StructField("holder_address", STRING),
        T.StructField("token_address", STRING),
        T.StructField("local_balance", DOUBLE),
        T.StructField("onchain_balance", DOUBLE),
        T.StructField("correction_amount", DOUBLE),
    ],
    "por_update": [
        T.StructField("exchange_ts", LONG),
        T.StructField("feed_address", STRING),
        T.StructField("token_address", STRING),
        T.StructField("reserves", DOUBLE),
        T.StructField("total_supply", DOUBLE),
        T.StructField("backing_ratio", DOUBLE),
        T.StructField("is_backed", BOOLEAN),
    ],
}
CHANNELS: dict[str, T.StructType] = {
    c: T.StructType(RECORD_FIELDS + LAYOUT_FIELDS + fields) for c, fields in EXTRA.items()
}

# Record fields whose names clash with layout columns: channel -> (record name, table name).
RENAMES = {
    "instrument": ("exchange", "exchange_name"),
    "short_volume": ("date", "date_val"),
    "macro_series": ("date", "date_val"),
}
# Values taken when a record leaves the field out.
DEFAULTS = {
    "book_snapshot": {"is_snapshot": True},
    "book_delta": {"is_snapshot": False},
    "quote": {"is_nbbo": False, "is_consolidated": False},
}


def channel_schema(channel: str) -> T.StructType:
    if channel not in CHANNELS:
        raise ValueError(f"unknown channel {channel!r}; known: {sorted(CHANNELS)}")
    return CHANNELS[channel]

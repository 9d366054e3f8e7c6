"""Column types of the market tables and the lists of features built from them."""

from __future__ import annotations

# Database type names and the Spark type each is read as.
TYPE_MAP = {
    "int": "int", "integer": "int", "serial": "int", "bigint": "bigint", "bigserial": "bigint",
    "smallint": "smallint", "smallserial": "smallint", "real": "float", "double precision": "double",
    "numeric": "decimal(38,10)", "decimal": "decimal(38,10)", "money": "decimal(19,2)", "boolean": "boolean",
    "bit": "string", "date": "date", "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz",
    "timestamp with time zone": "timestamp_ntz", "time": "string", "interval": "string", "text": "string",
    "char": "string", "character": "string", "varchar": "string", "character varying": "string", "uuid": "string",
    "xml": "string", "inet": "string", "cidr": "string", "macaddr": "string", "tsvector": "string",
    "tsquery": "string", "txid_snapshot": "string", "json": "string", "jsonb": "string", "bytea": "binary",
    "array": "array<string>", "national character": "string", "national character varying": "string", "point": "string",
    "line": "string", "lseg": "string", "box": "string", "path": "string", "polygon": "string", "circle": "string",
}


def spark_type(database_type: str) -> str | None:
    """The Spark type of a database type, whatever its length, e.g. ``varchar(20)``; None if it is not known."""
    name, _, rest = database_type.strip().lower().partition("(")
    numbers, _, tail = rest.partition(")")
    if name.strip() in ("numeric", "decimal") and numbers:
        return f"decimal({numbers})"
    if name.strip().endswith("[]") or tail.strip().endswith("[]"):
        return TYPE_MAP["array"]
    return TYPE_MAP.get(f"{name.strip()} {tail.strip()}".strip())


def columns(ddl: str) -> dict[str, str]:
    """Column names and Spark types of a table's DDL, in order."""
    return dict(part.strip().split(" ", 1) for part in ddl.split(","))


# Table schemas as DDL, for readers and casts.
BASIC_STOCK_DATA = (
    "symbol string, date date, open double, high double, low double, close double, volume double, "
    "sp500_return double, nasdaq_return double, gdp_growth double, inflation_rate double, unemployment_rate double")

ENRICHED_STOCK_DATA = BASIC_STOCK_DATA + (
    ", "
    "market_capitalization double, pe_ratio double, dividend_yield double, beta double, rsi double, macd double, "
    "macd_signal double, macd_hist double, adx double, upper_band double, lower_band double, sentiment_score double, "
    "put_call_ratio double, implied_volatility double, sector_performance double, reported_eps double, "
    "estimated_eps double, eps_surprise double, eps_surprise_percentage double, last_earnings_date date, "
    "next_earnings_date date, next_earnings_estimated_eps double")

TRAINED_MODELS = (
    "model_key string, symbol string, prediction_date date, prediction_explanation string, prediction_rmse double, "
    "prediction_mae double, prediction_mape double, prediction_confidence_score double, feature_importance string, "
    "model_parameters string, predicted_amount double, last_known_price double, predictions_json string, "
    "model_location string, date_created timestamp_ntz")

TRAINED_MODELS_BINARY = (
    "model_key string, symbol string, prediction_date date, prediction_explanation string, prediction_accuracy double, "
    "prediction_precision double, prediction_recall double, prediction_f1_score double, prediction_roc_auc double, "
    "confusion_matrix string, feature_importance string, model_parameters string, predicted_movement string, "
    "predicted_price double, prediction_probability double, last_known_price double, predictions_json string, "
    "model_location string, date_created timestamp_ntz")

PREDICTIONS_LOG = (
    "model_key string, symbol string, date date, model string, prediction_date date, predicted_price double, "
    "last_known_price double, model_parameters string, model_location string, date_created timestamp_ntz, "
    "predictions_json string")

AI_ANALYSIS = ("model_key string, explanation string, created_date timestamp_ntz")

AI_STOCK_PREDICTIONS = (
    "symbol string, date date, predicted_amount double, prediction_date date, prediction_explanation string, "
    "prediction_rmse double, prediction_confidence_score double, up_or_down string, date_created date, "
    "feature_importance string")

# Features by set, in their order.  pct_k and pct_d are the stochastic %K and %D.
BASIC_FEATURES = [
    "volume", "open", "high", "low", "close", "sp500_return", "nasdaq_return", "gdp_growth", "inflation_rate",
    "unemployment_rate", "gdp_growth_lag_1", "gdp_growth_lag_7", "gdp_growth_lag_30", "inflation_rate_lag_1",
    "inflation_rate_lag_7", "inflation_rate_lag_30", "unemployment_rate_lag_1", "unemployment_rate_lag_7",
    "unemployment_rate_lag_30", "macd_hist", "adx", "macd", "rsi", "upper_band", "lower_band", "macd_signal",
    "rolling_volatility_60", "corr_sp500_60", "corr_nasdaq_60", "sma_50", "sma_100", "ema_50", "pct_k", "pct_d", "cci",
    "momentum_30", "momentum_60",
]
ADVANCED_FEATURES = BASIC_FEATURES + [
    "sentiment_score", "implied_volatility", "market_capitalization", "pe_ratio", "dividend_yield", "beta",
    "put_call_ratio", "sector_performance", "sector_performance_lag_1", "sector_performance_lag_7",
    "sector_performance_lag_30", "sp500_return_lag_1", "sp500_return_lag_7", "sp500_return_lag_30",
    "nasdaq_return_lag_1", "nasdaq_return_lag_7", "nasdaq_return_lag_30", "sentiment_score_lag_1",
]
FEATURE_SETS = {"basic": BASIC_FEATURES, "advanced": ADVANCED_FEATURES}

# Sector name, upper case, and the fund that tracks it.
SECTOR_ETF = {
    "TECHNOLOGY": "XLK", "HEALTHCARE": "XLV", "HEALTH CARE": "XLV", "FINANCIALS": "XLF", "FINANCE": "XLF",
    "CONSUMER DISCRETIONARY": "XLY", "CONSUMER STAPLES": "XLP", "ENERGY": "XLE", "ENERGY & TRANSPORTATION": "XLE",
    "INDUSTRIALS": "XLI", "MANUFACTURING": "XLI", "MATERIALS": "XLB", "REAL ESTATE": "XLRE",
    "TELECOMMUNICATION SERVICES": "XLC", "COMMUNICATION SERVICES": "XLC", "UTILITIES": "XLU",
    "TRADE & SERVICES": "XLY", "LIFE SCIENCES": "XLP",
}

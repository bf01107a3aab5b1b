"""Declared table schemas and their unique keys."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _L, _B = T.DoubleType(), T.StringType(), T.LongType(), T.BooleanType()
_TS = T.TimestampNTZType()


def _struct(required: dict, optional: dict) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in required.items()] +
                        [T.StructField(n, t, True) for n, t in optional.items()])


MARKET_DATA = _struct(
    dict(symbol=_S, timestamp=_TS, timeframe=_S, source=_S, open=_D, high=_D, low=_D, close=_D, volume=_D),
    dict(vwap=_D, trades_count=_L, quality_score=_D, created_at=_TS, updated_at=_TS))

SENTIMENT_DATA = _struct(
    dict(symbol=_S, timestamp=_TS, source=_S, sentiment_score=_D, confidence=_D),
    dict(mention_count=_L, bullish_signals=_L, bearish_signals=_L, neutral_signals=_L, total_engagement=_D,
         avg_engagement=_D, keywords=T.ArrayType(_S), emotions=T.MapType(_S, _D), quality_score=_D,
         raw_data=T.MapType(_S, _S)))

# The numeric ratios of a fundamentals record.
RATIOS = (
    "market_cap pe_ratio peg_ratio book_value dividend_per_share dividend_yield eps revenue_per_share profit_margin "
    "operating_margin return_on_assets return_on_equity revenue gross_profit ebitda diluted_eps "
    "quarterly_earnings_growth quarterly_revenue_growth analyst_target_price trailing_pe forward_pe "
    "price_to_sales price_to_book beta").split()

FUNDAMENTAL_DATA = _struct(dict(symbol=_S, period=_S, timestamp=_TS),
                           {**{r: _D for r in RATIOS}, "sector": _S, "industry": _S})

TRADING_SIGNALS = _struct(
    dict(signal_id=_S, symbol=_S, timestamp=_TS, signal_type=_S, strength=_D, confidence=_D),
    dict(target_price=_D, stop_price=_D, model=_S, technical_score=_D, sentiment_score=_D, executed=_B,
         executed_price=_D, executed_at=_TS, expires_at=_TS))

FEATURE_DATA = _struct(
    dict(symbol=_S, timestamp=_TS, timeframe=_S, feature_version=_S),
    dict(features=T.MapType(_S, _D), total=_L, missing=_L, quality_score=_D))

PERFORMANCE_METRICS = _struct(
    dict(strategy_name=_S, date=T.DateType()),
    dict(total_return=_D, volatility=_D, sharpe=_D, sortino=_D, max_drawdown=_D, var_95=_D, cvar_95=_D, trades=_L))

ECONOMIC_DATA = _struct(dict(indicator=_S, timestamp=_TS, source=_S, value=_D),
                        dict(unit=_S, frequency=_S, revision=_L))

NEWS_DATA = _struct(
    dict(article_id=_S, title=_S, published_at=_TS),
    dict(summary=_S, url=_S, source=_S, symbols=T.ArrayType(_S), topics=T.ArrayType(_S), sentiment_score=_D,
         relevance=_D))

LEVEL = T.StructType([T.StructField("price", _D), T.StructField("size", _D), T.StructField("orders", _L)])
BOOK = _struct(dict(symbol=_S, ts=_TS), dict(bids=T.ArrayType(LEVEL), asks=T.ArrayType(LEVEL)))

TABLES = {
    "market_data": (MARKET_DATA, ("symbol", "timestamp", "timeframe", "source")),
    "sentiment_data": (SENTIMENT_DATA, ("symbol", "timestamp", "source")),
    "fundamental_data": (FUNDAMENTAL_DATA, ("symbol", "period", "timestamp")),
    "trading_signals": (TRADING_SIGNALS, ("signal_id",)),
    "feature_data": (FEATURE_DATA, ("symbol", "timestamp", "timeframe", "feature_version")),
    "performance_metrics": (PERFORMANCE_METRICS, ("strategy_name", "date")),
    "economic_data": (ECONOMIC_DATA, ("indicator", "timestamp", "source")),
    "news_data": (NEWS_DATA, ("article_id",)),
}

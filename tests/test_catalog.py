"""Oracle parity on the smallest data, the driver contract, and plan checks."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL

PARITY = [
    "tech_ema", "tech_adx", "tech_parabolic_sar", "quality_ohlc", "clean_fill_gaps",
    "clean_outliers_cap", "join_asof_backward", "text_social_alerts", "news_impact", "sentiment_fusion",
    "impact_venue_allocation", "tca_venue_stats", "risk_correlation_pairs", "ledger_positions_ticks",
    "rule_trade_stats", "portfolio_regime_allocation", "drift_ks", "stream_bars", "stream_positions",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", PARITY)
def test_parity(spark, con, name):
    status, note, *_ = check.compare(spark, con, name, SMALL)
    assert status == "ok", note


def test_contract(spark):
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q) and len(q) > 250
    assert entry(spark).count() > 0


PLANS = [
    "flagship_latest_features", "tech_macd", "variant_quoted_spread", "clean_outliers_cap", "join_asof_backward",
    "join_range_two_minutes", "text_mentions_symbol", "text_viral_posts", "sentiment_anomaly_7d", "sentiment_fusion", "book_placement_choice",
    "impact_vwap_slices", "tca_trade_costs", "risk_correlation_pairs", "risk_position_correlation", "stops_support_resistance",
    "portfolio_score", "rebalance_triggers", "drift_ks", "eval_best_threshold", "data_temporal_split", "ensemble_diversity",
]


@pytest.mark.parametrize("name", PLANS)
def test_plans_have_no_products(spark, name):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark):
    from marketloom.sources.adapters import Market
    df = Market(spark, SMALL).raw("events").filter("event_type = 'click'").select("value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan

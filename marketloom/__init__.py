"""Spark-native market, sentiment, execution and portfolio analytics."""

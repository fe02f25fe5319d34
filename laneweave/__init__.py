"""Spark-first routing, interval and partitioning operators for aligned reads."""

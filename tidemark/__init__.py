"""Limit-order-book analytics and market-data preparation on Spark."""

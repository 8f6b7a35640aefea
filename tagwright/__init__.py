"""Listing features and price estimates as Spark DataFrame operators."""

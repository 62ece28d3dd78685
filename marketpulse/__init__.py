"""Equity news sentiment and stock-index analytics as Spark jobs."""

"""Marketplace catalogue analytics on Spark: searches, totals, classification and batch changes."""

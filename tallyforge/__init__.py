"""Audit analytics on Spark: plan checks, validate results, roll up fail-closed statuses, trace evidence."""

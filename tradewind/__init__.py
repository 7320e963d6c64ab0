"""Layered retail analytics on Spark: load, check, clean, model, ask."""

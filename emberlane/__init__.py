"""Attention analytics on Spark: mention counts, event detection, stance panels, duration models, agreement studies."""

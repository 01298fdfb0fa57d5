"""Spark-native alignment of multi-rate telemetry: runs, cycle tables, as-of joins, frames, pairs and splits."""

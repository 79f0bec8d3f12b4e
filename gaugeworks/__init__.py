"""Spark-native analytics for industrial telemetry."""

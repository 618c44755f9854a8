"""Spark-native analytics for visual features, tracks and geometry."""

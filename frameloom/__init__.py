"""Frameloom: Spark-native analytics for video-perception tables and streams."""

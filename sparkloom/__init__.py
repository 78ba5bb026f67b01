"""Spark-native analytics over code, dependency, work-queue and event tables."""

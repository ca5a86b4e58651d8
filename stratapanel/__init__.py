"""Spark-native analytics over ``(date, key)`` panels."""

"""Spark-native engine for genomic records and interval data."""

"""Spark-native operators for building, auditing and evaluating labelled multilingual text corpora."""

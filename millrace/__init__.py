"""Spark-native curation of record corpora and evaluation of predictions."""

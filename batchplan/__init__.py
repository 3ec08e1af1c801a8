"""Spark-native planning of variable-size batches over text corpora."""

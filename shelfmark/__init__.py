"""shelfmark: a Spark-native engine for building, auditing and searching text corpora."""

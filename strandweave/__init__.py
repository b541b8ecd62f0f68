"""Spark-native analytics for genomic structural variants."""

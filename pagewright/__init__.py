"""Spark-native processing of paged documents: Markdown assembly, layout geometry, content-addressed caches."""

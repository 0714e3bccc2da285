"""Spark-first analytics over collections of articles, pages and their usage logs."""

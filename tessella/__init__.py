"""Spark-first analytics engine for speech and text corpora: composable DataFrame operators."""

"""Spark-first analytics over longitudinal photo albums: operators, functions, sources, plans, streaming."""

"""A Spark-first analytics engine: datasets, measures, cubes, logs, replicated state and data-preparation operators."""

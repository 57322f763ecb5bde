"""cadentia: a Spark-first analytics engine for libraries of time-based recordings."""

"""Table jobs as Spark DataFrame operators."""

"""Job-posting skill analytics as Spark DataFrame operators."""

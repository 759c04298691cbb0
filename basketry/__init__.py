"""Product recommendations from a retail purchase log, as Spark DataFrame operators."""

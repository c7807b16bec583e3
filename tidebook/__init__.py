"""Order-book window analytics as Spark DataFrame jobs."""

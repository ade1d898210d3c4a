"""Research-corpus analytics as Spark DataFrame operators."""

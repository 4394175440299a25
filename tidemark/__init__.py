"""Online learning, streaming statistics and decision analytics as Spark DataFrame operators."""

"""Past-only match analytics as Spark DataFrame operators."""

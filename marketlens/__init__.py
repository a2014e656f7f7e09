"""marketlens: point-in-time market and event analytics as Spark DataFrame operators."""

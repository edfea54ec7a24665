"""Analytics for security telemetry and large text corpora on PySpark."""

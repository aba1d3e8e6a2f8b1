"""spanloom: performance-trace analytics as composable PySpark DataFrame operators."""

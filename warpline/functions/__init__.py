"""Column functions that stay inside generated JVM code."""

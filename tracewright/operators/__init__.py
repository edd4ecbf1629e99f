"""tracewright.operators."""

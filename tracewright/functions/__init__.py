"""tracewright.functions."""

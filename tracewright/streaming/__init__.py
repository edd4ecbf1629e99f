"""tracewright.streaming."""

"""tracewright.sources."""

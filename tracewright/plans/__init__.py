"""tracewright.plans."""

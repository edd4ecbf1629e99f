"""tracewright: analytics over agent traces as Spark plans."""

VERSION = "0.3.0"

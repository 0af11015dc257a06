"""svloom: interval-structured genomic analytics as declarative Spark plans."""

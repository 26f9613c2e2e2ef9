"""siftlake: rule findings, metrics and reports over source-code corpora on Spark."""

"""Panel analytics on Spark: keyed tables, scores, indicators, statistics and publication as DataFrame plans."""

"""Job-market analytics on Spark: sources, filters, keys, scores, funnels and state as DataFrame transformations."""

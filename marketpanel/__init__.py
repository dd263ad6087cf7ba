"""Market-price panels on Spark: DataFrame in, DataFrame out, no global session."""

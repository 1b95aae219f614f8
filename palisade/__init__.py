"""palisade: bundle scanning and corpus preparation on Spark DataFrames."""

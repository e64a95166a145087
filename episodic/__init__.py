"""episodic: event analytics over multi-channel sensor series, on Spark DataFrames."""

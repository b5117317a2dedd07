"""chronotrace: anomaly analytics over long, ordered observation logs, as Spark DataFrames."""

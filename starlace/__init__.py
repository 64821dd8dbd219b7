"""Graph pattern matching over labelled graphs, and a training-data pipeline, on Spark DataFrames."""

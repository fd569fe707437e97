"""quarrylens: a dataset profiler built on Spark DataFrames."""

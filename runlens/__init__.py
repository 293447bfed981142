"""runlens: analytics over command-run traces, on Spark DataFrames."""

"""Source-code corpora as DataFrames: scans, symbols, facts, rules and reports on Spark."""

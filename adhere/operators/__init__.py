"""Table-wide operators: functions from DataFrames to a lazy DataFrame."""

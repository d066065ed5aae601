"""Operators: functions from DataFrames to DataFrames. None runs a job by itself."""

"""Operators: functions of DataFrames and column names that return lazy DataFrames."""

"""Operators: functions from DataFrames to DataFrames, options in frozen dataclasses."""

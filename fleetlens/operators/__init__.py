"""The analyses: functions from DataFrames to DataFrames."""

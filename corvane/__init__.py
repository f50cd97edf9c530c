"""Corvane: population statistics, window ranking and sequence operators on Spark DataFrames."""

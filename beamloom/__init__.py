"""Beamloom: particle-tracking analytics on Spark DataFrames."""

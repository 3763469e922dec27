"""Mention analytics on Spark: runs, items, sightings and labels as DataFrames."""

"""Ride operators on DataFrames."""

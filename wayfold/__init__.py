"""Ride-grouping analytics on PySpark: snapping, network distance, matching, grouping, evaluation."""

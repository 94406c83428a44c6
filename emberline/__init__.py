"""Wildfire-weather analytics as Spark DataFrame plans."""

"""Freeway-detector and road-charging-load analytics as Spark DataFrame operators."""

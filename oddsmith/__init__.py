"""Forecast, odds and text analytics on Spark."""

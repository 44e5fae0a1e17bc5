"""Forecast models over packed series."""

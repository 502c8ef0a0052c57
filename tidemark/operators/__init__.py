"""operators of the time-series engine."""

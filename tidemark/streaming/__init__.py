"""streaming of the time-series engine."""

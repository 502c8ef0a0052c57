"""sources of the time-series engine."""

"""functions of the time-series engine."""

"""plans of the time-series engine."""

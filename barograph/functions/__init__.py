"""Column helpers: frames, distribution functions, small solves on aggregated moments."""

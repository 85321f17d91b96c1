"""Analytics over large panels of keyed time series, written for Spark."""

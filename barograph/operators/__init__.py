"""Operators, each a plain ``DataFrame -> DataFrame`` function."""

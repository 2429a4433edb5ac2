"""Scalar functions: rounding and integer rules, stable ordering keys, geometry and text parsing."""

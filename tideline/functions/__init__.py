"""Scalar functions over stream values: Spark columns on the main path, Python values in the stepper."""

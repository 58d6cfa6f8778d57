"""Scalar functions, the filter language, and helpers over ordered columns."""

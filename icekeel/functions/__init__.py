"""Scalar functions: paths and URIs, space-filling order, back-off."""

"""Scalar expressions that the operators share."""

"""Scalar functions: columns in, columns out, so that they stay inside whole-stage code generation."""

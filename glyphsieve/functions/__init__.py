"""Scalar functions: characters, expressions, globs, sentences."""

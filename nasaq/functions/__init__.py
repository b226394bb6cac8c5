"""Scalar functions: comparison keys, transliteration, and explanations."""

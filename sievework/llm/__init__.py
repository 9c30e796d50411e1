"""Operators that turn collections of text and code into training data. Nothing outside this package imports it."""

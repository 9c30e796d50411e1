"""The rules: each a filter and projection of a view of the files that yields raw findings."""

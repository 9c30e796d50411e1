"""Sinks of the engine: reports of a run."""

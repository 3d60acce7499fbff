"""Logical inputs: the engine's own tables as views over the driver's tables."""

"""Ordered, stateful operators, in batches and as streams."""

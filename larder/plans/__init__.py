"""Operators put together: imports, matching, reports, and the queries on the driver's tables."""

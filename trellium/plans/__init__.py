"""Registered queries: operators bound to the driver's tables, and their SQL."""

"""Registered queries: operators applied to the driver's tables or to inline rows, each with its SQL."""

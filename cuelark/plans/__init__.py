"""Registered queries: operators over projections of the given tables, each with its SQL oracle."""

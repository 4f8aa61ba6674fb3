"""Registered queries: operators applied to the harness tables, each with its SQL oracle."""

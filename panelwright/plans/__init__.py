"""Registered queries: each joins the library's operators to the given tables, beside its SQL oracle."""

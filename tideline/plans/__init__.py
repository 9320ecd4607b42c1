"""Registered queries and their SQL. The catalog comes first, whichever module is asked for: the others take its names."""

from tideline.plans import catalog  # noqa: F401

"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from rewardloom.catalog.registry import QUERIES, SQL

# Importing the modules fills the registry.
from rewardloom.catalog import answers, chats, mixing, reporting, rewards, sampling, streams, tokens  # noqa: E402,F401

__all__ = ["QUERIES", "SQL"]

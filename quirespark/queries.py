"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from quirespark.plans import books, clips, conversations, desk, dialogue, jobs, names, queue, sounds, sources, stages, wordlist  # noqa: F401
from quirespark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Importing this registers every query of the library."""

from . import facts, feeds, market, more, notes, texts, work, written

__all__ = ["facts", "feeds", "market", "more", "notes", "texts", "work", "written"]

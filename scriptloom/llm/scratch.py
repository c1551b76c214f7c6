"""Intermediate tables of the corpus operators: those of the library."""

from ..scratch import durable, shared_folder

__all__ = ["durable", "shared_folder"]

"""Intermediate tables of these operators, see corpusloom.sources.shared."""

from corpusloom.sources.shared import BROADCAST_ROWS, bounded_broadcast, discard, fresh_path, materialise, numbered, shared_dir, small_batches, small_table

__all__ = ["BROADCAST_ROWS", "bounded_broadcast", "discard", "fresh_path", "materialise", "numbered", "shared_dir", "small_batches", "small_table"]

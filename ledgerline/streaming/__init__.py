"""Incremental execution of row-level cleaning steps.

The recipes this library re-expresses contain no streams, watermarks or
stateful operators, so none are provided. What is offered is the append
load (``INSERT INTO staging SELECT cleaned ... FROM raw``) run
incrementally: new raw files are cleaned with the same stateless
operators and appended exactly once to a staging table.
"""

from ledgerline.streaming.incremental import incremental_append

__all__ = ["incremental_append"]

"""reelhouse: media catalog, job state machines, access control and progress
analytics expressed as Spark DataFrame / SQL / Structured Streaming plans.

Sub-packages:
  sources    table scans, fixture views, text / JSON / file-tree sources and sinks
  functions  Column-level helpers (parsing, predicates, path cleaning)
  operators  DataFrame -> DataFrame operators (lookups, RBAC, upserts, state machines, progress, logs)
  plans      registered query builders and their DuckDB oracle SQL; versioned commits
  streaming  Structured Streaming forms of the progress and log pipelines
"""

__all__ = ["session", "schemas"]

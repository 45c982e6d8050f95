"""Vehicle-telemetry analytics as Spark DataFrame operators.

Every operator works on all drive sessions at once: ``session_id`` is a grouping
key, never a loop variable.  ``only_sessions`` narrows any table to a few ids.
"""

from gaugeflow.schema import Fleet, load_tables, only_sessions, write_tables

__all__ = ["Fleet", "load_tables", "only_sessions", "write_tables"]

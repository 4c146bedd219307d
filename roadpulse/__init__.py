"""roadpulse — road-incident analytics expressed as Spark DataFrame plans.

Sub-packages:

* ``sources``   — table scans, CSV/XML/JSON readers and parquet sinks.
* ``functions`` — column-expression builders (time, text, geo, risk, hashing).
* ``operators`` — DataFrame -> DataFrame operators (cleaning, profiling,
  splitting, encoding, risk scoring, queue roll-ups, evaluation, graph,
  spatial snapping, learning).
* ``plans``     — adapters that give the benchmark tables the incident shape,
  plus the query catalogue with its SQL oracle.
* ``streaming`` — Structured Streaming versions of the intake/queue jobs.
"""

__all__ = ["session"]

"""Pipeline failure analysis as Spark DataFrame jobs.

Subpackages:
  functions  column-expression helpers (text, regex, vectors, JSON)
  sources    readers and writers for bronze CSV, JSON artifacts, task logs
  operators  medallion layers, checks, logs, incidents, memory, reports, drift
  plans      rule tables and the check planner
  streaming  trigger stream -> incident upsert
"""

__version__ = "0.1.0"

"""Repository-risk analytics as Spark DataFrames.

Files, commands, rules, policy, approvals and audit logs are tables or streams; every operator
takes and returns DataFrames (or Columns) and keys its rows by repository, snapshot and command.
"""

__version__ = "0.1.0"

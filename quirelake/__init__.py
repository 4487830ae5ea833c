"""Quirelake: paged-document analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames (or Columns, in ``functions``) and
stays lazy: Catalyst plans the work, executors run it.
"""

from quirelake.session import build_session, configure, work_folder

__all__ = ["build_session", "configure", "work_folder"]

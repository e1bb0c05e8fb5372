"""spanlake: Spark-native extractive question-answering data engine.

Every public operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, windows, joins and aggregates.  Nothing here creates a
session, collects rows to the driver, or runs a row-at-a-time Python UDF on the
default path.
"""

from spanlake.config import QA_SCHEMA, DecodeConfig, WindowConfig

__all__ = ["QA_SCHEMA", "DecodeConfig", "WindowConfig"]

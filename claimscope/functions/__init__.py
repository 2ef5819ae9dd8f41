"""Column functions: the dashboard's template filters and text formats as
native Spark expressions (no Python UDF)."""

from claimscope.functions.scalar import *  # noqa: F401,F403

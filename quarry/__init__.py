"""quarry: analytics jobs written as plain Spark DataFrame / SQL / Streaming code.

Every job is a function ``DataFrame(s) -> DataFrame``; ``quarry.plans.registry`` wraps
them as ``(spark, sf_dir) -> DataFrame`` for ``__spark_entry__.py``.
"""

__all__ = ["session"]

"""tallyspark: card-ledger reconciliation and report linearization on Spark.

Every operator takes and returns DataFrames; the heavy work is joins,
aggregates, set operations and ordered windows that Catalyst plans and
Spark distributes.
"""

from tallyspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

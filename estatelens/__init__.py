"""Estate lineage and audit engine on PySpark.

An *estate* is a set of DataFrames (measures, columns, relationships, bindings, ...), every one keyed by
``model_id``.  Operators take DataFrames and return DataFrames; Catalyst and AQE pick the physical plan.
"""

from estatelens.estate import Estate
from estatelens.session import checkpoint, session

__all__ = ["Estate", "checkpoint", "session"]

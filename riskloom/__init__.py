"""riskloom: outcome-risk analytics for booking-like entity tables, built on Spark.

Everything is a DataFrame-in / DataFrame-out function.  Sub-packages:

- ``functions``  column expressions (cleansing, parsing, risk classes, rates, labels)
- ``operators``  relational operators (cleanse, label, features, latest, queue,
                 reports, evaluate, actions, ml, distributed ranking)
- ``sources``    readers/writers (CSV scan, artifact stores, layers) and the adapter
                 that maps the driver's TPC-H-like tables onto the entity schemas
- ``plans``      the registered query catalogue and its DuckDB oracle SQL
- ``streaming``  micro-batch ingestion of action requests into the action log
"""

from riskloom.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]

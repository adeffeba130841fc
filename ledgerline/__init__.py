"""ledgerline — reusable, parameterised PySpark DataFrame operators for
everyday analytics: cleaning, data-quality audits, rankings, time series,
baskets, reconciliation and tabular model jobs.

Every operator is a pure, lazy ``DataFrame -> DataFrame`` (or
``Column -> Column``) function built from built-in Spark SQL expressions,
so Catalyst can push filters, prune columns and pick join strategies.
"""

from ledgerline.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"

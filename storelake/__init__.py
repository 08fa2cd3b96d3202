"""storelake: retail analytics on Spark.

The shop model (users, catalog, variants and stock, orders and lines, carts,
wishlists, complaints, addresses) is held as twelve DataFrames.  Every
operator is a plain function over those DataFrames that returns a lazy
DataFrame (or a dict of DataFrames for jobs that produce new snapshots), so
Catalyst plans, prunes and pushes down across operator boundaries.
"""

from storelake.session import get_session, checkpoint_dir
from storelake.sources.model import Tables, load_model

__all__ = ["get_session", "checkpoint_dir", "Tables", "load_model"]

from marketframe.plans import (  # noqa: F401
    boosted_queries, evaluation_queries, indicator_queries, join_queries, model_queries, order_queries, scan_queries, stream_queries,
    table_queries)
from marketframe.plans.catalog import CATALOG, oracle
from marketframe.plans.inputs import Inputs

__all__ = ["CATALOG", "Inputs", "oracle"]

"""riskloom: a PySpark toolkit for binary risk scores on wide tables.

Every operator is a lazy DataFrame transformation or a small fitted state
(a dict or a tiny table) plus such a transformation. Global orderings go
through :mod:`riskloom.operators.ordering`, which never funnels a table
through a single partition.
"""

__version__ = "0.1.0"

KEY = "SK_ID_CURR"
LABEL = "TARGET"

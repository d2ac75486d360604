"""The registered queries of the library and their SQL."""

from __future__ import annotations

import inspect

from minuteflow.plans import queries
from minuteflow.plans.oracles import ORACLES  # noqa: F401

_HELPERS = {"mentions", "edges", "semantics", "stored_documents", "table", "route"}
QUERIES = {name: f for name, f in inspect.getmembers(queries, inspect.isfunction) if f.__module__ == queries.__name__ and not name.startswith("_") and name not in _HELPERS}
FLAGSHIP = "ranked_search"

"""The scalar functions by name: ``SCALARS[name](context, *columns) -> Column``.

A context knows the type of a column and the literal value of an argument, for the few functions whose
meaning depends on either. Names are lower case; unknown names are an error, as are missing arguments.
"""

from __future__ import annotations

from pelagraph.functions.registry import SCALARS, Context, register
from pelagraph.functions import casts, dates, graph, lists, misc, numbers, texts, vectors  # noqa: F401, E402  (they fill SCALARS)
from pelagraph.functions import documents, language  # noqa: F401, E402

__all__ = ["SCALARS", "Context", "register"]

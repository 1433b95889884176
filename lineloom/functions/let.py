"""Let-bindings inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, each of which is evaluated once a row.

    Columns added one after the other are merged into one projection, and then repeat wherever they are used, inside
    lambdas once an element; the argument of a lambda over a one-element array is not.
    """
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), F.lit(0))

"""The three fallback rules of the configs (SURVEY §1.4 (1)).

They look alike but differ on empty text, so each has its own helper:

* ``absent_or(x, d)``: ``dict.get(k, d)`` - only an absent key (NULL) falls back.
* ``blank_or(x, *d)``: ``a or b`` - NULL and ``''`` fall back.
* ``shell_blank_or(x, d)``: shell tests - NULL, ``''`` and the word ``null`` fall back.

A key present with a null value is taken as absent (the original raises on
it when it casts); this is the documented deviation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def absent_or(x, default) -> Column:
    return F.coalesce(_c(x), _c(default))


def blank(x) -> Column:
    """NULL for NULL or empty text."""
    return F.nullif(_c(x), F.lit(""))


def blank_or(x, *defaults) -> Column:
    return F.coalesce(blank(x), *[blank(d) if isinstance(d, Column) else _c(d) for d in defaults])


def shell_blank(x) -> Column:
    return F.nullif(F.nullif(_c(x), F.lit("")), F.lit("null"))


def shell_blank_or(x, default) -> Column:
    return F.coalesce(shell_blank(x), _c(default))

"""Kept columns whose names an operator needs itself."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def kept_apart(*also: str, left_out: str = "") -> Callable:
    """For operators over a table with a parameter ``keep``: kept columns that start with ``__`` or are named in ``also``
    bear other names while the operator runs and get theirs back in its result, where a result column of the same
    name goes first. Names are compared as Spark does, without case. Without such columns nothing is changed.
    ``left_out``: the parameter that names a column the operator does not keep by default."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)
        table = next(iter(signature.parameters))

        @functools.wraps(operator)
        def run(*args, **options) -> DataFrame:
            given = signature.bind(*args, **options)
            given.apply_defaults()
            rows = given.arguments[table]
            keep = given.arguments.get("keep")
            if keep is None:
                keep = [c for c in rows.columns if c != given.arguments.get(left_out)]
            clashing = [c for c in keep if c.startswith("__") or c.lower() in also]
            if not clashing:
                return operator(*args, **options)
            taken, own = {c.lower() for c in rows.columns}, {}
            for name in clashing:
                i = len(taken)
                while f"kept_{i}" in taken:
                    i += 1
                own[name] = f"kept_{i}"
                taken.add(own[name])
            given.arguments[table] = rows.withColumns({new: _column(name) for name, new in own.items()})
            given.arguments["keep"] = [own.get(c, c) for c in keep]
            found = operator(*given.args, **given.kwargs)
            names, made = {new: name for name, new in own.items()}, {c.lower() for c in found.columns}
            return found.select(
                *[_column(c).alias(names.get(c, c)) for c in found.columns if c not in names or names[c].lower() not in made]
            )

        return run

    return wrap

"""Group columns of any name: inside an operator they carry reserved names."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame

PREFIX = "__key"


def _restored(result, inner: dict[str, str]):
    if isinstance(result, DataFrame):
        taken = set(result.columns)
        back = {r: f"group_{k}" if k in taken else k for k, r in inner.items() if r in taken}
        return result.withColumnsRenamed(back)
    if isinstance(result, tuple):
        parts = [_restored(x, inner) for x in result]
        return type(result)(*parts) if hasattr(result, "_fields") else tuple(parts)
    return result


def reserved_keys(operator: Callable) -> Callable:
    """Rename the columns of ``group_by`` on entry and back on exit.

    An operator's own column names then never meet those of the caller. Where a result has
    a column of the same name as a group column, the latter comes back as ``group_<name>``.
    """
    signature = inspect.signature(operator)
    first = next(iter(signature.parameters))

    @wraps(operator)
    def call(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        keys = list(bound.arguments.get("group_by") or ())
        if not keys or all(k.startswith(PREFIX) for k in keys):
            return operator(*args, **kwargs)
        df = bound.arguments[first]
        if missing := [k for k in keys if k not in df.columns]:
            raise ValueError(f"columns not found: {missing}")
        inner = {k: f"{PREFIX}{i}" for i, k in enumerate(keys)}
        bound.arguments[first] = df.withColumnsRenamed(inner)
        bound.arguments["group_by"] = list(inner.values())
        return _restored(operator(*bound.args, **bound.kwargs), inner)

    return call

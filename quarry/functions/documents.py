"""JSON trees: canonical form, flattening, patching and redaction, as Arrow-batched functions over their text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST_ITEMS = 50
SECRET_NAMES = ("password", "token", "secret", "authorization")


def _tree(text: str | None):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical(s: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null for what isn't JSON."""
    return s.map(lambda v: None if (t := _tree(v)) is None else json.dumps(t, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


@F.pandas_udf(StringType())
def flattened(s: pd.Series) -> pd.Series:
    """`path: value` for every leaf, in order of paths, one to a line."""

    def leaves(t, path: str):
        if isinstance(t, dict):
            for k in sorted(t):
                yield from leaves(t[k], f"{path}.{k}" if path else k)
        elif isinstance(t, list):
            for i, x in enumerate(t):
                yield from leaves(x, f"{path}[{i}]")
        else:
            yield f"{path}: {json.dumps(t, ensure_ascii=False) if not isinstance(t, str) else t}"

    return s.map(lambda v: None if (t := _tree(v)) is None else "\n".join(leaves(t, "")))


def protected():
    """Function of a JSON column that hides secrets by name and cuts arrays at a fixed length, at any depth."""

    def hide(t):
        if isinstance(t, dict):
            return {k: "[hidden]" if any(n in k.lower() for n in SECRET_NAMES) else hide(v) for k, v in t.items()}
        return [hide(x) for x in t[:MOST_ITEMS]] if isinstance(t, list) else t

    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if (t := _tree(v)) is None else json.dumps(hide(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return f


def patched(path: tuple[str, ...], value, allowed: frozenset[str]):
    """Function of a JSON column that sets the value at a path of allowed names; other paths are refused."""
    if not path or any(p not in allowed or p.startswith("__") or p in ("constructor", "prototype") for p in path):
        raise ValueError(f"path {'.'.join(path)!r} may not be set")

    def put(t, rest: tuple[str, ...]):
        t = dict(t) if isinstance(t, dict) else {}
        t[rest[0]] = value if len(rest) == 1 else put(t.get(rest[0]), rest[1:])
        return t

    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if (t := _tree(v)) is None else json.dumps(put(t, path), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return f

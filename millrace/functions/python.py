"""The few scalar functions that need Python: sequence similarity and trees."""

from __future__ import annotations

import difflib
import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructType

from millrace.functions.text import splitlines


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def edit_distance(a, b, mode: str = "compat") -> Column:
    """Normalised distance of two texts, 0 for equal ones.

    ``compat``: 1 - Ratcliff-Obershelp ratio with popular characters of the
    second text ignored, as Python's difflib has it; equal texts never reach
    Python.  ``levenshtein``: edits over the longer length, all in the JVM.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    if mode == "levenshtein":
        return F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b), F.lit(1))
    if mode != "compat":
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(a == b, F.lit(0.0)).otherwise(1 - _ratio(F.when(a != b, a), F.when(a != b, b)))


def _digests(lines) -> list[str]:
    """SHA-256 of the lines, joined by LF, without each interior line: what stands before it is hashed once for all."""
    whole = "\n".join(lines).encode()
    view, ends, at = memoryview(whole), [], 0
    for line in lines:
        at += len(line.encode()) + 1
        ends.append(at)
    before, out = hashlib.sha256(), []
    for i in range(1, len(lines) - 1):
        before.update(view[ends[i - 2] if i > 1 else 0 : ends[i - 1]])
        one = before.copy()
        one.update(view[ends[i] :])
        out.append(one.hexdigest())
    return out


@F.pandas_udf(ArrayType(StringType()))
def _digest_lists(lines: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _digests(x) for x in lines], dtype=object)


def drop_one_line_digests(text) -> Column:
    """SHA-256 of each of ``drop_one_line``'s candidates, joined by LF; the candidates, whose sizes are quadratic in the lines, are never made."""
    return _digest_lists(splitlines(text))


class _Node:
    """What is known of a JSON object once its members are read: nesting, an index that is no plain value, and its keys."""

    __slots__ = ("depth", "indexed", "keys", "members")
    #: Members that nest: (those that must all be there, what they add); the first that fits holds.
    NESTING = (({"lhs", "rhs"}, 1), ({"expr"}, 1), ({"index"}, 0))

    def __init__(self, members: dict):
        self.members, self.keys = members, members.keys()
        nest = next(((names, more) for names, more in self.NESTING if names <= self.keys), (set(), 0))
        self.depth = nest[1] + max((x.depth for x in map(members.get, nest[0]) if isinstance(x, _Node)), default=0)
        index = members.get("index")
        odd = {"cls", "index"} <= self.keys and not (isinstance(index, _Node) and index.keys == {"value"})
        self.indexed = odd or any(x.indexed for x in _nodes(members.values()))


def _nodes(values):
    """The objects in lists of any nesting."""
    todo = list(values)
    while todo:
        x = todo.pop()
        if isinstance(x, _Node):
            yield x
        elif isinstance(x, list):
            todo += x


def tree_facts(text: str | None):
    """(depth or None, indexed, loop) of a program tree as JSON; an unreadable or missing tree has no depth.

    The parser makes a node of each object when its members are complete, so
    the facts come up from the leaves.
    """
    try:
        tree = json.loads(text, object_hook=_Node) if text else None
    except ValueError:
        tree = None
    if not isinstance(tree, _Node):
        return None, False, False
    statements = [x for x in tree.members.get("statements", []) if isinstance(x, _Node)]
    return max((x.depth for x in statements), default=0), tree.indexed, any({"end_stmt", "loop_var"} <= x.keys for x in statements)


@F.pandas_udf(StructType().add("depth", IntegerType()).add("indexed", BooleanType()).add("loop", BooleanType()))
def tree_columns(tree: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tree_facts(t) for t in tree], columns=["depth", "indexed", "loop"])


def depth_bucket(depth) -> Column:
    d = F.col(depth) if isinstance(depth, str) else depth
    return F.when(d.isNull(), "unknown").when(d <= 1, "1").when(d == 2, "2").when(d == 3, "3").otherwise("4_plus")

"""Array functions over decks: ordered lines of fixed-column text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import bind, rstrip, strip


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(deck, drop_edges: bool = True, collapse: bool = False) -> Column:
    """Lines without trailing white space; optionally inner spaces collapsed and blank lines at both ends dropped."""

    def clean(line):
        x = rstrip(line)
        return bind(x, lambda v: F.when(strip(v) == "", "").otherwise(F.regexp_replace(v, " {2,}", " "))) if collapse else x

    def inner(out):
        solid = F.transform(out, lambda x: strip(x) != "")

        def cut(flags):
            first = F.array_position(flags, True).cast("int")
            last = F.size(flags) - F.array_position(F.reverse(flags), True).cast("int") + 1
            return F.when(first > 0, F.slice(out, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0)))).otherwise(F.slice(out, 1, 0))

        return bind(solid, cut)

    out = F.transform(_col(deck), clean)
    return bind(out, inner) if drop_edges else out


def split_tail(deck, n: int = 10) -> Column:
    """struct(body, tail) with the last n lines as the tail; null for a shorter deck."""
    d = _col(deck)
    size = F.size(d)
    return F.when(size >= n, F.struct(F.slice(d, 1, F.greatest(size - n, F.lit(0))).alias("body"), F.slice(d, F.greatest(size - n + 1, F.lit(1)), n).alias("tail")))


def joined(*decks) -> Column:
    return F.concat(*[_col(d) for d in decks])


def longest(a, b) -> Column:
    return F.greatest(F.size(_col(a)), F.size(_col(b)))


def diff_indices(a, b) -> Column:
    """Positions from 0 at which two decks differ; a missing line differs."""
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: ~x.eqNullSafe(y))
    numbered = F.transform(pairs, lambda d, i: F.when(d, i))
    return F.filter(numbered, lambda i: i.isNotNull())


def exact(a, b) -> Column:
    return _col(a) == _col(b)


def per_line_exact(a, b) -> Column:
    """Share of positions with equal lines; 0 for two empty decks."""
    same = F.filter(F.zip_with(_col(a), _col(b), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x)
    return F.size(same).cast("double") / F.greatest(longest(a, b), F.lit(1))


def line_at(deck, index) -> Column:
    """Line at a position from 0, empty beyond the end."""
    return F.coalesce(F.try_element_at(_col(deck), (index + 1).cast("int")), F.lit(""))


def negative_overpunch(digit) -> Column:
    """The letter of a digit, or of a digit with a plus over it, with a minus over it; ``!`` for anything else."""
    d = _col(digit)
    letters = F.translate(d, "0123456789?ABCDEFGHI", "!JKLMNOPQR!JKLMNOPQR")
    return F.when(letters.rlike("^[!JKLMNOPQR]$"), letters).otherwise("!")

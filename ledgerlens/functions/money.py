"""Amount parsing and exact money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Money is summed as DECIMAL so results do not depend on partition order
# (double addition is not associative).  8 digits after the point keep
# sub-cent amounts, 20 before it bound a row; sums widen to 38 digits.
MONEY = "decimal(28,8)"
# For sums of squares: a square must fit 38 digits with room for the sum.
MOMENT = "decimal(18,6)"

# What a plain number looks like once currency symbols and separators are
# removed.  Spark's cast also accepts '1.0d', 'NaN', 'Infinity'; the gate keeps
# those NULL, as a strict numeric parser would.
_NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def parse_amount(c: Column | str, generic: bool = False) -> Column:
    """Text -> DOUBLE.  Bank layouts strip ``$`` and ``,``; the generic layout
    also strips whitespace and reads ``(x)`` as ``-x``.  Unparseable -> NULL."""
    s = _col(c).cast("string")
    if generic:
        s = F.regexp_replace(s, r"[$,\s]", "")
        s = F.regexp_replace(s, r"\((.+)\)", "-$1")
    else:
        # Blank padding around the number is not part of it.
        s = F.regexp_replace(s, r"[$,]|^\s+|\s+$", "")
    return F.when(s.rlike(_NUMERIC), s.try_cast("double"))


def parse_number(c: Column | str) -> Column:
    """Strict numeric text -> DOUBLE, no symbol stripping (Plaid layout)."""
    s = strip(_col(c).cast("string"))
    return F.when(s.rlike(_NUMERIC), s.try_cast("double"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def exact_sum(c: Column, where: Column | None = None, over: WindowSpec | None = None, as_type: str = MONEY) -> Column:
    """Sum of money values as DOUBLE, 0 for no rows: exact for amounts that fit
    ``as_type``; larger ones (and sums beyond it) are added as doubles, so no
    amount fails a job."""
    def run(agg: Column) -> Column:
        return agg if over is None else agg.over(over)
    if where is not None:
        c = F.when(where, c)
    fits = c.try_cast(as_type)
    small = F.coalesce(run(F.try_sum(fits)).cast("double"), run(F.sum(F.when(fits.isNotNull(), c))), F.lit(0.0))
    return small + F.coalesce(run(F.sum(F.when(fits.isNull(), c))), F.lit(0.0))


def combine_debit_credit(debit: Column, credit: Column) -> Column:
    """-|debit| + |credit|, missing parts count as 0."""
    return F.coalesce(-F.abs(debit), F.lit(0.0)) + F.coalesce(F.abs(credit), F.lit(0.0))


def round_half_up(c: Column, digits: int) -> Column:
    """Round through DECIMAL so the result is the same in every SQL engine."""
    return F.coalesce(F.round(c.try_cast("decimal(38,10)"), digits).cast("double"), c)

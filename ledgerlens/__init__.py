"""ledgerlens — bank-ledger analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built on public
PySpark APIs.  Operators take ``keys`` (e.g. ``["account_id"]``): with no
keys a frame is treated as one statement, with keys every statistic,
window and detector is computed per account, which is what parallelises.
"""

__version__ = "0.1.0"

"""Deterministic transaction ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transaction_id(date_text: Column, raw_description: Column, amount: Column,
                   occurrence: Column | None = None, amount_text: Column | None = None) -> Column:
    """First 16 hex chars of sha256("date|raw|amount(4dp)[|occ]").

    NULL parts are rendered the way a text export would show them: a missing
    amount as ``nan`` and a missing date as ``nan``.  ``amount_text`` is that
    text of the amount where the caller has it already.
    """
    if amount_text is None:
        amount_text = F.coalesce(F.format_string("%.4f", amount), F.lit("nan"))
    payload = F.concat_ws("|", F.coalesce(date_text, F.lit("nan")),
                          F.coalesce(raw_description, F.lit("nan")), amount_text)
    if occurrence is not None:
        payload = F.when(occurrence > 0, F.concat_ws("|", payload, occurrence.cast("string"))).otherwise(payload)
    return F.substring(F.sha2(payload, 256), 1, 16)

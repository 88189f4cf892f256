"""Helper of the tests in this folder (not in conftest, whose name the tests below share)."""

from __future__ import annotations

from datetime import datetime


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)

"""Predicates as Columns. Absent conditions never enter the plan, so that what is left reaches the scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def conjunction(conditions: Iterable[Column | None], base: Column | None = None) -> Column:
    """All conditions that are there and the base; true where none is."""
    given = [c for c in (base, *conditions) if c is not None]
    return reduce(and_, given) if given else F.lit(True)


def is_false(col: str) -> Column:
    """False and not null."""
    return F.col(col).eqNullSafe(False)


def is_true(col: str) -> Column:
    return F.col(col).eqNullSafe(True)


def contains_text(col: str, text: str | None, ascii_only: bool = False) -> Column | None:
    """Case-insensitive pattern in the middle of a text; ``%`` and ``_`` in it are wildcards. None or empty: no condition.

    ascii_only folds A-Z alone, as some databases do; otherwise all letters fold.
    """
    if not text:
        return None
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    if not ascii_only:
        return F.col(col).ilike(pattern)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.col(col), upper, lower).like(pattern.translate(str.maketrans(upper, lower)))


def any_contains(cols: Iterable[str], text: str | None) -> Column | None:
    """Pattern in at least one of the columns."""
    tests = [contains_text(c, text) for c in cols]
    return reduce(or_, tests) if text else None


def at_least(col: str, value, falsy_is_absent: bool = True) -> Column | None:
    return None if value is None or falsy_is_absent and not value else F.col(col) >= value


def at_most(col: str, value, falsy_is_absent: bool = True) -> Column | None:
    return None if value is None or falsy_is_absent and not value else F.col(col) <= value


def half_open(col: str, start, end) -> Column:
    return (F.col(col) >= start) & (F.col(col) < end)


def one_of(col: str, values: Iterable | None) -> Column | None:
    return F.col(col).isin(*values) if values else None


def one_of_or_unset(col: str, values: Iterable | None) -> Column | None:
    """Membership that rows without a value pass."""
    return F.col(col).isNull() | (F.col(col) == "") | F.col(col).isin(*values) if values else None


def equals_or_any(col: str, value: str | None) -> Column | None:
    return F.col(col) == value if value else None


def region_matches(col: str, region: str | None, keywords: dict[str, list[str]], everywhere: str) -> Column | None:
    """A region's keywords in the lower-cased text; an unknown region as plain text; the whole country or none: no condition."""
    if not region or region == everywhere:
        return None
    text = F.lower(F.col(col))
    if region not in keywords:
        return F.contains(text, F.lit(region.lower()))
    return reduce(or_, [F.contains(text, F.lit(k)) for k in keywords[region]])


def keywords_match(text: Column, keywords: Column) -> Column:
    """Any keyword of an array column in the lower-cased text."""
    low = F.lower(text)
    return F.exists(keywords, lambda k: F.contains(low, k))


def live(expires_at: str, now: float) -> Column:
    """Without an end, or one after now."""
    return F.col(expires_at).isNull() | (F.col(expires_at) > now)


def trial_active(col: str, now) -> Column:
    """Strictly before the end; without an end, false."""
    return F.coalesce(F.lit(now) < F.col(col), F.lit(False))


SIX_DIGITS = r"^\d{6}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


PLAN_ID = r"^(free|lite|standard|pro)$"


def positive(col: str) -> Column:
    """Above 0; null is not."""
    return F.coalesce(F.col(col) > 0, F.lit(False))


def account_gate(active: str, credential: str) -> Column:
    """``ok``, ``invalid`` without a credential, else ``deactivated`` unless the account is active; a null flag is not active."""
    return F.when(F.coalesce(F.col(credential), F.lit("")) == "", "invalid").when(~is_true(active), "deactivated").otherwise("ok")


def dismissed_recently(at: Column, now_ms: Column | int, days: int = 14) -> Column:
    """Whether a stored time in milliseconds lies under so many days back. Nothing stored: no; blanks count as 0; text that is no number: yes."""
    ms = F.when(F.trim(at) == "", F.lit(0.0)).otherwise(F.trim(at).try_cast("double"))
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return F.when(F.coalesce(at, F.lit("")) == "", False).when(ms.isNull(), True).otherwise(now - ms < days * 86_400_000)


def page_arguments(page: int = 1, per_page: int = 20) -> tuple[int, int]:
    """(offset, limit) of a page; page from 1, at most 100 rows."""
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page must be 1 or more, per_page 1 to 100")
    return (page - 1) * per_page, per_page


def autocomplete(col: str, text: str) -> Column | None:
    """Trimmed, lower-cased text anywhere in the value."""
    t = text.strip().lower()
    return F.contains(F.lower(F.col(col)), F.lit(t)) if t else None

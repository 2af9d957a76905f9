"""Time expressions in words, read on the driver: the result goes into a query as literals."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

#: Units of time, in days, and the names of weekdays.
UNIT_DAYS = {"d": 1, "day": 1, "days": 1, "w": 7, "wk": 7, "week": 7, "weeks": 7, "m": 30, "mo": 30, "month": 30, "months": 30, "y": 365, "yr": 365, "year": 365, "years": 365, "h": 1 / 24, "hour": 1 / 24, "hours": 1 / 24}
DAYS = {"monday": 0, "mon": 0, "tuesday": 1, "tue": 1, "wednesday": 2, "wed": 2, "thursday": 3, "thu": 3, "friday": 4, "fri": 4, "saturday": 5, "sat": 5, "sunday": 6, "sun": 6}


def month_start(at: datetime, months: int) -> datetime:
    """The first day of the month that is so many months after at's."""
    year, month = divmod(at.year * 12 + at.month - 1 + months, 12)
    return at.replace(year=year, month=month + 1, day=1, hour=0, minute=0, second=0, microsecond=0)


def span(expression: str | None, now: datetime) -> tuple[datetime | None, datetime | None]:
    """(start, end) of an expression: periods have both, points only the start; (None, None) if it is none.

    ISO dates and times, "7d", "3 weeks ago", "yesterday", "this week", "last month", and weekdays: the latest, today
    included, or with "last" the latest before today.
    """
    x = " ".join((expression or "").lower().split())
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    week, points = midnight - timedelta(days=now.weekday()), {"now": now, "today": midnight, "yesterday": midnight - timedelta(days=1), "tomorrow": midnight + timedelta(days=1)}
    if x in points:
        return points[x], None
    for back, which in enumerate(("this", "last")):
        if x == f"{which} week":
            return week - timedelta(days=7 * back), week + timedelta(days=7 - 7 * back)
        if x == f"{which} month":
            return month_start(now, -back), month_start(now, 1 - back)
        if x == f"{which} year":
            return month_start(now.replace(month=1), -12 * back), month_start(now.replace(month=1), 12 - 12 * back)
    if (m := re.fullmatch(r"(\d+)\s*([a-z]+)(?:\s+ago)?", x)) and m[2] in UNIT_DAYS:
        return now - timedelta(days=int(m[1]) * UNIT_DAYS[m[2]]), None
    if (day := x.removeprefix("last ")) in DAYS:
        back = (now.weekday() - DAYS[day]) % 7
        return midnight - timedelta(days=back or (7 if x.startswith("last ") else 0)), None
    try:
        at = datetime.fromisoformat(x.upper().replace("Z", "+00:00"))
        return (at.replace(tzinfo=None) - at.utcoffset() if at.tzinfo else at), None
    except ValueError:
        return None, None


def parse(expression: str | None, now: datetime) -> datetime | None:
    """Where an expression starts."""
    return span(expression, now)[0]


def parse_range(since: str | None, until: str | None, now: datetime) -> tuple[datetime | None, datetime | None]:
    """Both ends: a period given as `since` alone ends where it ends, and one given as `until` ends at its own end; swapped
    if they are the wrong way round."""
    a, a_end = span(since, now)
    b, b_end = span(until, now)
    b = b_end or b or (a_end if not until else None)
    return (b, a) if a and b and a > b else (a, b)


ANCHORS = re.compile(r"\b(today|yesterday|(?:this|last) (?:week|month|year)|last (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|\d+ (?:hours?|days?|weeks?) ago|\d{4}-\d{2}-\d{2})\b", re.I)


def intent(query: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """The stretch of time that a question speaks of: from its first anchor, for the anchor's own length if it has one or
    names a day, else to now."""
    m = ANCHORS.search(query)
    if not m:
        return None, None
    since, until = span(m[0], now)
    a_day = not re.search(r"week|month|year|hour", m[0], re.I)
    return since, until or (since + timedelta(days=1) if since and a_day else now)

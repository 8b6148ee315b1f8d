"""Appointment time arithmetic.

Times are 12-hour text ("2:00 PM" or "02:00 PM"), so the pattern uses a
single ``h``.  Results are rendered as 'yyyy-MM-dd HH:mm:ss' text so they do
not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake import constants as K

PATTERN = "yyyy-MM-dd h:mm a"
OUT = "yyyy-MM-dd HH:mm:ss"


def slot_start(date: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(PATTERN)).cast("timestamp_ntz")


def slot_start_text(date: Column, time: Column) -> Column:
    return F.date_format(slot_start(date, time), OUT)


def slot_end_text(date: Column, time: Column, minutes: int = K.SLOT_MINUTES) -> Column:
    return F.date_format(slot_start(date, time) + F.expr(f"INTERVAL {int(minutes)} MINUTES"), OUT)


def split_date_time(text: Column) -> tuple[Column, Column]:
    """'<date> <time>' split on the first space; missing time -> default."""
    parts = F.split(text, " ", 2)
    date = F.element_at(parts, 1)
    time = F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.lit(K.DEFAULT_SLOT_TIME))
    return date, time


def schedule_at(as_of: Column, schedule_type: Column) -> Column:
    """as_of + offset of the schedule type (1h, 2h, 2 days, 7 days)."""
    expr = None
    for kind, offset in K.SCHEDULE_OFFSETS.items():
        val = as_of + F.expr(f"INTERVAL {offset}")
        expr = F.when(schedule_type == kind, val) if expr is None else expr.when(schedule_type == kind, val)
    return expr


def sql_slot_start(date: str, time: str) -> str:
    return f"try_strptime({date} || ' ' || {time}, '%Y-%m-%d %I:%M %p')"


def sql_slot_end(date: str, time: str, minutes: int = K.SLOT_MINUTES) -> str:
    return f"strftime({sql_slot_start(date, time)} + INTERVAL {int(minutes)} MINUTE, '%Y-%m-%d %H:%M:%S')"


def _sql_fmt(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def sql_slot_start_text(date: str, time: str) -> str:
    return _sql_fmt(sql_slot_start(date, time))


def sql_schedule_at(as_of: str, schedule_type: str) -> str:
    whens = " ".join(f"WHEN {schedule_type} = '{k}' THEN {as_of} + INTERVAL {v}" for k, v in K.SCHEDULE_OFFSETS.items())
    return f"(CASE {whens} END)"

"""Inclusive date ranges, presets and comparison periods."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DAYS = 400
PRESETS = ("today", "yesterday", "7d", "30d", "90d", "12mo")


def _minus_year(day: dt.date) -> dt.date:
    """The same day a year before; 29 February overflows to 1 March."""
    try:
        return day.replace(year=day.year - 1)
    except ValueError:
        return dt.date(day.year - 1, 3, 1)


@dataclass(frozen=True)
class DateRange:
    start: dt.date
    end: dt.date
    token: str = "custom"

    @classmethod
    def preset(cls, token: str, today: dt.date) -> DateRange:
        day = dt.timedelta(days=1)
        if token == "today":
            return cls(today, today, token)
        if token == "yesterday":
            return cls(today - day, today - day, token)
        if token == "12mo":
            return cls(_minus_year(today) + day, today, token)
        days = {"7d": 7, "30d": 30, "90d": 90}
        token = token if token in days else "30d"
        return cls(today - day * (days[token] - 1), today, token)

    @classmethod
    def custom(cls, start: dt.date, end: dt.date, today: dt.date) -> DateRange:
        """Swapped if reversed, not past today, at most MAX_DAYS ending at the end."""
        start, end = min(start, end), max(start, end)
        start, end = min(start, today), min(end, today)
        return cls(max(start, end - dt.timedelta(days=MAX_DAYS - 1)), end)

    @classmethod
    def parse(cls, token: str, today: dt.date) -> DateRange:
        """A preset, or `YYYY-MM-DD:YYYY-MM-DD`; anything else is the last 30 days."""
        parts = token.split(":")
        if len(parts) == 2:
            days = [cls._strict(p) for p in parts]
            if None not in days:
                return cls.custom(days[0], days[1], today)
        return cls.preset(token, today)

    @staticmethod
    def _strict(text: str) -> dt.date | None:
        try:
            day = dt.datetime.strptime(text, "%Y-%m-%d").date()
        except ValueError:
            return None
        return day if day.isoformat() == text else None

    @classmethod
    def is_valid(cls, token: str) -> bool:
        parts = token.split(":")
        return token in PRESETS or (len(parts) == 2 and all(cls._strict(p) for p in parts))

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def is_hourly(self) -> bool:
        return self.days == 1

    def includes(self, day: dt.date) -> bool:
        return self.start <= day <= self.end

    def previous(self) -> DateRange:
        """The period of the same length just before."""
        return DateRange(self.start - dt.timedelta(days=self.days), self.start - dt.timedelta(days=1), "previous")

    def calendar(self, spark: SparkSession) -> DataFrame:
        """Column `date`, a row for each day."""
        a, b = (F.lit(x.isoformat()).cast("date") for x in (self.start, self.end))
        return spark.range(1).select(F.explode(F.sequence(a, b)).alias("date"))


def months_before(day: dt.date, months: int) -> dt.date:
    """`day` so many months earlier; a day the month lacks runs over into the next one."""
    index = day.year * 12 + day.month - 1 - months
    return dt.date(index // 12, index % 12 + 1, 1) + dt.timedelta(days=day.day - 1)

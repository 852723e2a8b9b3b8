"""The simulated clock: real time runs `ratio` times faster on the simulated axis."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clock:
    sim_start: datetime
    real_anchor: datetime
    ratio: float = 288.0

    def to_sim(self, real: datetime) -> datetime:
        return self.sim_start + (real - self.real_anchor) * self.ratio

    def to_real(self, sim: datetime) -> datetime:
        return self.real_anchor + (sim - self.sim_start) / self.ratio

    def sim_column(self, real: Column) -> Column:
        """The simulated instant of a column of real instants (both microseconds of UTC)."""
        epoch = datetime(1970, 1, 1, tzinfo=self.sim_start.tzinfo)
        micros = lambda t: (t - epoch) // timedelta(microseconds=1)
        return F.lit(micros(self.sim_start)) + ((real - F.lit(micros(self.real_anchor))) * F.lit(self.ratio)).cast("bigint")

    def sim_minutes(self, real_minutes: float) -> float:
        """A real duration on the simulated axis, as for watermarks and windows."""
        return real_minutes * self.ratio

    def day_bounds(self, day: datetime) -> tuple[datetime, datetime]:
        """Half-open."""
        start = day.replace(hour=0, minute=0, second=0, microsecond=0)
        return start, start + timedelta(days=1)


@dataclass(frozen=True)
class TimeBudget:
    """Durations that must fit together; all of them on the simulated axis, in minutes."""

    ratio: float = 288.0
    watermark_real_minutes: float = 2.0
    window_real_minutes: float = 1.0
    readings_per_tick: int = 200
    tick_seconds: float = 2.0
    records_per_batch: int = 2_000

    @property
    def span(self) -> float:
        """Event time that one micro-batch covers."""
        return self.records_per_batch / self.readings_per_tick * self.tick_seconds * self.ratio / 60

    @property
    def watermark(self) -> float:
        return self.watermark_real_minutes * self.ratio

    @property
    def window(self) -> float:
        return self.window_real_minutes * self.ratio

    def check(self) -> None:
        """Raises ValueError unless watermark > span, watermark >= window and window >= span."""
        if not self.watermark > self.span:
            raise ValueError(f"a batch spans {self.span:g} simulated minutes, the watermark only {self.watermark:g}: valid rows would be dropped")
        if not self.watermark >= self.window:
            raise ValueError(f"the window of {self.window:g} simulated minutes is longer than the watermark of {self.watermark:g}")
        if not self.window >= self.span:
            raise ValueError(f"a batch spans {self.span:g} simulated minutes, more than the window of {self.window:g}")

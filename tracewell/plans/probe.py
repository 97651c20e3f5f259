"""The events of a probe as a job that goes on where it stopped: a table per stage, a ledger of finished channels beside each.

Stages: ``prepared`` (samples), ``spectrogram``, ``events`` and ``mask``. A channel counts as done when every stage has it, and
only such channels are returned, so a reader never sees events without their mask. Settings are stored with each stage;
others raise. A channel whose part of a stage is gone is built again in that stage, from the stages that are there.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bursts as U
from ..operators import chunks as H
from ..operators.masks import channel_key
from ..sources import cache, files
from . import workflows as P

STAGES = ("prepared", "spectrogram", "events", "mask")


@dataclass(frozen=True)
class Settings:
    fs: float
    freqs: list[float]
    bands: list[str]
    t1: float = 0.0
    t2: float | None = None
    winsz: float = 10.0
    threshold: float = 4.0
    dynamic: float | None = None
    overlap: float = 0.5
    overrides: dict[str, tuple[float, float]] = field(default_factory=dict)
    repair: bool = True
    current: bool = False
    ncycle_min: float | None = None
    filtsigcor_min: float | None = None

    @property
    def size(self) -> int:
        return int(self.winsz * self.fs)


def channel_of(y: str = "y") -> Column:
    """A depth as the name of its channel."""
    return channel_key(F.col(y))


def status(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """The channels that each stage has finished."""
    return {s: cache.finished(spark, f"{path}/{s}", "channel") if files.exists(spark, f"{path}/{s}.done") else set() for s in STAGES}


def run(spark: SparkSession, path: str, signal: DataFrame, settings: Settings, channels: list[str] | None = None, step: int | None = None) -> dict[str, DataFrame]:
    """Builds what is missing of the channels (all of ``y, i, t, v`` if not named) and returns the stages' tables.

    ``step`` channels at a time; a run that is killed loses its unfinished step of one stage.
    """
    path = path.rstrip("/")
    there = {r["channel"] for r in signal.select(channel_of().alias("channel")).distinct().collect()}  # of a probe: some hundred
    wanted = sorted(there) if channels is None else list(channels)
    if unknown := sorted(set(wanted) - there):
        raise ValueError(f"the signal has no channels {unknown}")
    meta = asdict(settings)
    stage = lambda name, build: cache.append_missing(spark, f"{path}/{name}", wanted, build, meta, "channel", step)
    of = lambda df, part: df.where(F.col("channel").isin(part))

    def prepared(part: list[str]) -> DataFrame:
        ready = P.prepare(signal if settings.current else of(signal.withColumn("channel", channel_of()), part), settings.t1, settings.t2, settings.repair, settings.current)
        return of(ready.withColumn("channel", channel_of()), part)

    ready = stage("prepared", prepared)
    chunks = lambda part: H.to_chunks(P.counted_from(of(ready, part), settings.t1, settings.fs), ["channel"], settings.size)
    spectra = stage("spectrogram", lambda part: P.chunk_spectrograms(chunks(part), settings.fs, settings.freqs, settings.size))

    def events(part: list[str]) -> DataFrame:
        found = U.detect(chunks(part), settings.fs, settings.freqs, settings.size, settings.threshold, overlap=settings.overlap, dynamic=settings.dynamic, bands=settings.overrides)
        names = found.withColumn("channel", F.substring_index("channel", "_", -1))
        return P.raw_events(names, settings.bands, settings.t1, settings.ncycle_min, settings.filtsigcor_min).withColumn("channel", channel_of("chan"))

    found = stage("events", events)

    def masked(part: list[str]) -> DataFrame:
        samples = P.counted_from(of(ready, part).withColumn("place", F.col("i")), settings.t1, settings.fs)
        rows = P.event_mask(of(found, part), samples, settings.t1, 1 / settings.fs, ("place",))
        return rows.select("y", F.col("place").alias("i"), "m", channel_of().alias("channel"))

    mask = stage("mask", masked)
    done = sorted(set.intersection(*status(spark, path).values()))
    return {name: of(df, done) for name, df in zip(STAGES, (ready, spectra, found, mask), strict=True)}

"""Projections of one nested simulation result (a JSON document per job) to the relational form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema of a result document.
RESULT = (
    "simConfig struct<recordLFP:array<array<double>>,recordStep:double,dt:double,duration:double,sizeY:double>, "
    "net struct<pops:map<string,struct<cellGids:array<bigint>,tags:struct<ynormRange:array<double>>>>,cells:array<struct<tags:struct<pop:string>>>,params:struct<popParams:map<string,struct<cellType:string>>>>, "
    "simData struct<LFP:array<array<double>>,LFPPops:map<string,array<array<double>>>,spkid:array<bigint>,spkt:array<double>,t:array<double>,V_soma:map<string,array<double>>>"
)

#: Of that, what ``trains_only`` keeps: a reader with this schema skips the rest of a document.
TRAINS = "net struct<pops:map<string,struct<cellGids:array<bigint>,tags:struct<ynormRange:array<double>>>>>, simData struct<spkid:array<bigint>,spkt:array<double>>"


def schema(*traces: str) -> str:
    """The schema of documents that record other traces of cells beside ``V_soma``."""
    more = "".join(f",{t}:map<string,array<double>>" for t in traces if t != "V_soma")
    return RESULT[:-1] + more + ">"


def _ids(df: DataFrame) -> list[str]:
    return [c for c in ("job_id",) if c in df.columns]


def trains_only(results: DataFrame) -> DataFrame:
    """Documents that keep their populations and spikes: all that ``pops``, ``cells`` and ``spikes`` read but the depth."""
    return results.select(*_ids(results), F.struct(F.lit(None).cast("double").alias("sizeY")).alias("simConfig"), F.struct("net.pops").alias("net"), F.struct("simData.spkid", "simData.spkt").alias("simData"))


def pops(results: DataFrame) -> DataFrame:
    """``pop, pop_ord, gids, n_cells, y_lo, y_hi`` (depth units) in document order."""
    rows = results.select(*_ids(results), "simConfig.sizeY", F.posexplode(F.map_entries("net.pops")).alias("pop_ord", "e"))
    y = F.col("e.value.tags.ynormRange")
    return rows.select(*_ids(results), F.col("e.key").alias("pop"), "pop_ord", F.col("e.value.cellGids").alias("gids"), F.size("e.value.cellGids").cast("long").alias("n_cells"), (F.get(y, F.lit(0)) * F.col("sizeY")).alias("y_lo"), (F.get(y, F.lit(1)) * F.col("sizeY")).alias("y_hi"))


def cells(results: DataFrame) -> DataFrame:
    """``pop, pop_ord, cell_ord, gid`` of every cell, in the populations' order."""
    p = pops(results)
    return p.select(*_ids(p), "pop", "pop_ord", F.posexplode("gids").alias("cell_ord", "gid"))


def pop_params(results: DataFrame, field: str = "cellType") -> DataFrame:
    return results.select(*_ids(results), F.explode("net.params.popParams").alias("pop", "p")).select(*_ids(results), "pop", F.col(f"p.{field}").alias(field))


def net_size(results: DataFrame) -> DataFrame:
    """Cells per population by the cells' own tags; populations without cells have 0."""
    found = results.select(*_ids(results), F.explode("net.cells").alias("c")).groupBy(*_ids(results), F.col("c.tags.pop").alias("pop")).agg(F.count(F.lit(1)).alias("n_cells"))
    return pops(results).select(*_ids(results), "pop").join(found, [*_ids(results), "pop"], "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0).cast("long")))


def duration(results: DataFrame) -> DataFrame:
    """Duration and time step in seconds."""
    return results.select(*_ids(results), (F.col("simConfig.duration") / 1000).alias("duration_s"), (F.col("simConfig.dt") / 1000).alias("dt_s"))


def record_times(results: DataFrame) -> DataFrame:
    """``i, t``: sample times in ms, from 0 below the duration."""
    n = F.ceil(F.col("simConfig.duration") / F.col("simConfig.recordStep")).cast("int")
    rows = results.select(*_ids(results), F.col("simConfig.recordStep").alias("step"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("i"))
    return rows.select(*_ids(results), F.col("i").cast("long").alias("i"), (F.col("i") * F.col("step")).alias("t"))


def spikes(results: DataFrame) -> DataFrame:
    """``gid, t`` in seconds; arrays of unequal length are cut by neither: missing values are null."""
    z = F.explode(F.arrays_zip(F.col("simData.spkid").alias("gid"), F.col("simData.spkt").alias("t")))
    return results.select(*_ids(results), z.alias("s")).select(*_ids(results), F.col("s.gid").alias("gid"), (F.col("s.t") / 1000).alias("t"))


def lfp_coords(results: DataFrame) -> DataFrame:
    return results.select(*_ids(results), F.posexplode("simConfig.recordLFP").alias("ch", "xyz")).select(*_ids(results), "ch", F.get("xyz", F.lit(0)).alias("x"), F.get("xyz", F.lit(1)).alias("y"))


def lfp(results: DataFrame) -> DataFrame:
    """``ch, y, i, t, v``: potentials by channel and sample; t in seconds."""
    rows = results.select(*_ids(results), F.col("simConfig.recordStep").alias("step"), F.posexplode("simData.LFP").alias("i", "row")).select(*_ids(results), "step", F.col("i").cast("long").alias("i"), F.posexplode("row").alias("ch", "v"))
    return rows.join(lfp_coords(results).select(*_ids(results), "ch", "y"), [*_ids(results), "ch"]).select(*_ids(results), "ch", "y", "i", (F.col("i") * F.col("step") / 1000).alias("t"), "v")


def pop_lfps(results: DataFrame) -> DataFrame:
    """``pop, ch, y, i, v``; populations without potentials have no rows."""
    rows = results.select(*_ids(results), F.explode("simData.LFPPops").alias("pop", "m")).select(*_ids(results), "pop", F.posexplode("m").alias("i", "row")).select(*_ids(results), "pop", F.col("i").cast("long").alias("i"), F.posexplode("row").alias("ch", "v"))
    return rows.join(lfp_coords(results).select(*_ids(results), "ch", "y"), [*_ids(results), "ch"]).select(*_ids(results), "pop", "ch", "y", "i", "v")


def voltages(results: DataFrame, trace: str = "V_soma", limits: tuple[float | None, float | None] = (None, None), ms: bool = True) -> DataFrame:
    """``pop, gid, rec_ord, i, t, v`` of cells' traces; gid from the trace's name, limits in the output's unit and closed."""
    rows = results.select(*_ids(results), F.col("simData.t").alias("times"), F.posexplode(F.map_entries(f"simData.{trace}")).alias("rec_ord", "e"))
    rows = rows.withColumn("gid", F.regexp_extract("e.key", r"_(\d+)$", 1).cast("long"))
    rows = rows.select(*_ids(results), "gid", "rec_ord", F.posexplode(F.arrays_zip("times", F.col("e.value").alias("v"))).alias("i", "s"))
    t = F.col("s.times") if ms else F.col("s.times") / 1000
    out = rows.select(*_ids(results), "gid", "rec_ord", F.col("i").cast("long").alias("i"), t.alias("t"), F.col("s.v").alias("v")).join(cells(results).select(*_ids(results), "pop", "gid"), [*_ids(results), "gid"])
    lo, hi = limits
    return out.where((F.lit(True) if lo is None else F.col("t") >= lo) & (F.lit(True) if hi is None else F.col("t") <= hi))


def nested(path: str, column: str | None = None) -> Column:
    """A dotted path, of struct fields or within a JSON string column."""
    return F.col(path) if column is None else F.get_json_object(column, f"$.{path}")

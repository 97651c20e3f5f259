"""Archives of trains, one NPZ file per job: a data source that writes them from sorted rows, each published at commit.

Members of an archive: ``format_version``, ``pop_names``, how the trains were taken (``meta__*``), and for each population its
size, its cells' gids, all times one cell after another and the offsets between cells.
"""

from __future__ import annotations

import io
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Version of the layout (fixed value).
VERSION = 1
META = {"combine": (bool, False), "t0": (np.float64, 0.0), "tmax": (np.float64, 0.0), "subtract_t0": (bool, False), "ms": (bool, False), "ndigits": (np.int64, -1)}


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, of a URI or a local path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def encode(trains: dict[str, list[tuple[int, np.ndarray]]], pops: dict[str, int], meta: dict) -> bytes:
    """An archive of populations' cells (gid, times); ``pops`` gives the order and the sizes, also of silent populations."""
    members = {"format_version": np.array(VERSION, np.int64), "pop_names": np.array(list(pops), dtype=str)}
    members |= {f"meta__{k}": np.array(meta.get(k, d), dtype=kind) for k, (kind, d) in META.items()}
    for k, (pop, size) in enumerate(pops.items()):
        cells = trains.get(pop, [])
        times = np.concatenate([t for _, t in cells]) if cells else np.empty(0)
        members[f"pop_{k}__pop_size"] = np.array(size, np.int64)
        if meta.get("combine"):
            members[f"pop_{k}__combined_times"] = np.sort(times)
        else:
            members[f"pop_{k}__cell_gids"] = np.array([g for g, _ in cells], np.int64)
            members[f"pop_{k}__cell_times"] = times
            members[f"pop_{k}__cell_offsets"] = np.cumsum([0, *(len(t) for _, t in cells)])
    out = io.BytesIO()
    np.savez(out, **members)
    return out.getvalue()


def matches_request(meta: dict, pops: list[str], request: dict, wanted: list[str]) -> bool:
    """Whether an archive holds what is asked for: the same populations in the same order, taken in the same way in every respect."""
    if unknown := set(request) - set(META):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    same = all((kind(meta.get(k, d)) == kind(request.get(k, d))) for k, (kind, d) in META.items())
    return list(pops) == list(wanted) and bool(same)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: as they were written, and their names to be."""

    names: list[tuple[str, str]]


class TrainsWriter(DataSourceWriter):
    """Tasks write their jobs' archives into a folder of this write; commit moves them into place, abort deletes them."""

    def __init__(self, options: dict) -> None:
        self.path, self.template = options["path"].rstrip("/"), options.get("template", "spikes_{job:05d}.npz")
        self.pops, self.meta = dict(json.loads(options["pops"])), json.loads(options.get("meta", "{}"))
        self.folder = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, folder = place(self.folder)
        system.create_dir(folder, recursive=True)
        names = []
        for job, rows in itertools.groupby(iterator, key=lambda r: r["job_id"]):
            trains: dict[str, list[tuple[int, np.ndarray]]] = {}
            for (pop, gid), cell in itertools.groupby(rows, key=lambda r: (r["pop"], r["gid"])):
                if pop not in self.pops:
                    raise ValueError(f"job {job} has spikes of {pop}, which is no population of the archive")
                trains.setdefault(pop, []).append((gid, np.array([r["t"] for r in cell])))
            final = self.template.format(job=int(job))
            attempt = f"{folder}/{final}.{uuid.uuid4().hex}"
            with system.open_output_stream(attempt) as f:
                f.write(encode(trains, self.pops, self.meta))
            names.append((attempt, final))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = place(self.folder)
        _, root = place(self.path)
        for m in messages:
            for attempt, final in m.names if m else []:
                system.move(attempt, f"{root}/{final}")
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*place(self.folder))

    @staticmethod
    def _clear(system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class Trains(DataSource):
    """``df.write.format("trains")``; options ``path, pops, meta, template``."""

    @classmethod
    def name(cls) -> str:
        return "trains"

    def writer(self, schema, overwrite: bool) -> TrainsWriter:
        if missing := {"job_id", "pop", "gid", "t"} - set(schema.fieldNames()):
            raise ValueError(f"trains need columns {sorted(missing)}")
        return TrainsWriter(dict(self.options))


def save_ragged(spikes: DataFrame, folder: str, pops: dict[str, int], meta: dict | None = None, template: str = "spikes_{job:05d}.npz") -> None:
    """Spike rows ``job_id, pop, gid, t`` as an archive per job that has spikes; a job's archive is one task's work.

    Populations are written in the order of ``pops``, cells by gid, times in order. What was there under a name is replaced;
    when the write fails, nothing is.
    """
    if unknown := set(meta or {}) - set(META):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    spikes.sparkSession.dataSource.register(Trains)
    rows = spikes.select("job_id", "pop", "gid", "t").repartition("job_id").sortWithinPartitions("job_id", "pop", "gid", "t")
    rows.write.format("trains").mode("append").option("pops", json.dumps(list(pops.items()))).option("meta", json.dumps(meta or {})).option("template", template).save(folder)

"""Single-file indexes in SQLite, version 1: read as a Spark data source, written from an index.

The file holds meta(k, v), qlut(t, w), postings(t, docs, ws) with little-endian arrays, docs and pending. Reading
is distributed by ranges of term or id; every task opens the file read-only, so it must lie on storage that all
executors see. Tasks write ranges of terms or ids to files of their own, which are then appended to the one file, table
by table; no row goes through Spark's driver.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

NAME = "impact_sqlite"
RANGES = 32
SCHEMAS = {
    "postings": "term int, doc_id long, w double",
    "qlut": "term int, qw double",
    "docs": "id long, ext_id string, title string, body string, meta string, deleted boolean, ntokens int, truncated boolean",
    "pending": "id long, ext_id string, title string, body string",
    "meta": "k string, v string",
    "vocab": "term int, token string",
}
_SQL = {
    "postings": "select t, docs, ws from postings where t between ? and ? order by t",
    "qlut": "select t, w from qlut where t between ? and ?",
    "docs": "select id, ext_id, title, body, meta, deleted, {ntokens}, {truncated} from docs where id between ? and ?",
    "pending": "select id, ext_id, title, body from pending where id between ? and ?",
    "meta": "select k, v from meta where ? <= ?",
}


_KEY, _TEXT, _INT = "integer primary key", "text", "integer"
_DDL = {
    "meta": {"k": "text primary key", "v": _TEXT},
    "qlut": {"t": _KEY, "w": "real"},
    "postings": {"t": _KEY, "docs": "blob", "ws": "blob"},
    "docs": {"id": _KEY + " autoincrement", "ext_id": "text unique"}
    | dict.fromkeys(("title", "body", "meta"), _TEXT)
    | {"deleted": "integer default 0"}
    | dict.fromkeys(("ntokens", "truncated"), _INT),
    "pending": {"id": _KEY + " autoincrement"} | dict.fromkeys(("ext_id", "title"), _TEXT) | {"body": "text not null"},
}


def connect(path: str) -> sqlite3.Connection:
    path = path.removeprefix("file://")
    if not Path(path).is_file():
        raise FileNotFoundError(f"cannot open {path}")
    return sqlite3.connect(Path(path).resolve().as_uri() + "?mode=ro", uri=True)


def read_meta(db: sqlite3.Connection, path: str) -> dict[str, str]:
    """The meta table; a file whose format is not of version 1 is refused."""
    try:
        meta = {str(k): v for k, v in db.execute("select * from meta")}
    except sqlite3.DatabaseError as e:
        raise ValueError(f"{path} is not a sparse index database") from e
    name, _, version = meta.get("format", "").rpartition("/")
    if not name or version != "1":
        raise ValueError(f"{path} is not a sparse/1 database")
    return meta


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Terms(InputPartition):
    def __init__(self, terms: list[int]):
        self.terms = terms


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table
        self.low: int | None = None
        self.high: int | None = None
        self.terms: list[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        key = {"postings": "term", "qlut": "term", "docs": "id", "pending": "id"}.get(self.table)
        for f in filters:
            if key and getattr(f, "attribute", None) == (key,):
                if isinstance(f, EqualTo):
                    self.terms = [f.value] if self.terms is None else [t for t in self.terms if t == f.value]
                    continue
                if isinstance(f, In):
                    self.terms = list(f.value) if self.terms is None else [t for t in self.terms if t in f.value]
                    continue
                if isinstance(f, GreaterThanOrEqual):
                    self.low = max(f.value, self.low if self.low is not None else f.value)
                    continue
                if isinstance(f, LessThanOrEqual):
                    self.high = min(f.value, self.high if self.high is not None else f.value)
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as db:
            read_meta(db, self.path)
            if self.table in ("meta", "vocab"):
                return [_Range(0, 0)]
            if self.terms is not None:
                low = self.low if self.low is not None else -(2**62)
                high = self.high if self.high is not None else 2**62
                wanted = sorted({int(t) for t in self.terms if t is not None and low <= t <= high})
                step = max(1, -(-len(wanted) // RANGES))
                return [_Terms(wanted[i : i + step]) for i in range(0, len(wanted), step)] or [_Terms([])]
            key = "t" if self.table in ("postings", "qlut") else "id"
            low, high = db.execute(f"select min({key}), max({key}) from {self.table}").fetchone()
        if low is None:
            return [_Terms([])]
        low = max(low, self.low) if self.low is not None else low
        high = min(high, self.high) if self.high is not None else high
        step = max(1, -(-(high - low + 1) // RANGES))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)] or [_Terms([])]

    def read(self, partition: InputPartition) -> Iterator:
        with connect(self.path) as db:
            meta = read_meta(db, self.path)
            spans = [(t, t) for t in partition.terms] if isinstance(partition, _Terms) else [(partition.low, partition.high)]
            if self.table == "vocab":
                yield from enumerate(json.loads(meta["vocab"]))
                return
            if self.table == "postings":
                for low, high in spans:
                    yield from _postings(db, meta, low, high)
                return
            sql = _SQL[self.table]
            if self.table == "docs":
                have = {r[1] for r in db.execute("pragma table_info(docs)")}
                sql = sql.format(**{c: c if c in have else "null" for c in ("ntokens", "truncated")})
            for low, high in spans:
                for r in db.execute(sql, (low, high)):
                    yield (*r[:5], bool(r[5]), r[6], None if r[7] is None else bool(r[7])) if self.table == "docs" else r


#: Postings of a batch that is read, about.
READ_ROWS = 1 << 16


def _postings(db: sqlite3.Connection, meta: dict[str, str], low: int, high: int) -> Iterator[pa.RecordBatch]:
    u8 = meta.get("weight_mode", "u8") == "u8"
    scale = float(meta.get("weight_scale") or 40) if u8 else 1.0
    terms, docs, ws, n = [], [], [], 0

    def batch() -> pa.RecordBatch:
        t = np.repeat(np.array(terms, np.int32), [len(d) for d in docs])
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.concatenate(docs)), pa.array(np.concatenate(ws))], ["term", "doc_id", "w"])

    for t, ids, weights in db.execute(_SQL["postings"], (low, high)):
        d = np.frombuffer(ids, "<i4").astype(np.int64)
        w = np.frombuffer(weights, np.uint8 if u8 else "<f4").astype(np.float64) / scale
        if len(d) != len(w):
            raise ValueError(f"the arrays of term {t} differ in length")
        terms.append(t)
        docs.append(d)
        ws.append(w)
        n += len(d)
        if n >= READ_ROWS:
            yield batch()
            terms, docs, ws, n = [], [], [], 0
    if terms:
        yield batch()


class ImpactSqlite(DataSource):
    """spark.read.format("impact_sqlite").option("path", file).option("table", "postings").load()"""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "postings")
        if table not in SCHEMAS:
            raise ValueError("table must be one of " + ", ".join(SCHEMAS))
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._table())


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImpactSqlite)
    return spark.read.format(NAME).option("path", path).option("table", table).load()


#: Postings that a task takes together before it hands them on; rows of a file that a task writes, about.
CHUNK, PART_ROWS = 1 << 20, 4_000_000
_RUNS = "t int, first long, docs binary, ws binary"


def _pack(u8: bool):
    """Postings (term, doc_id, w) to rows of _RUNS: arrays of what a task holds of a term at a time."""
    kind = np.uint8 if u8 else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> pa.RecordBatch:
            t, d, w = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
            held.clear()
            order = np.lexsort((d, t))
            t, d, w = t[order], d[order], w[order].astype(kind)
            cuts = np.flatnonzero(np.diff(t, prepend=t[0] - 1))
            spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(t)], strict=True))
            blobs = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (d.astype("<i4"), w)]
            return pa.RecordBatch.from_arrays([pa.array(t[cuts], pa.int32()), pa.array(d[cuts], pa.int64()), *blobs], ["t", "first", "docs", "ws"])

        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK:
                yield emit()
                n = 0
        if held:
            yield emit()

    return run


def _joined(rows: Iterator[tuple], u8: bool) -> Iterator[tuple]:
    """Rows of _RUNS in order to one row for each term, its documents ascending."""
    for t, runs in groupby(rows, key=lambda r: r[0]):
        runs = list(runs)
        d = np.frombuffer(b"".join(r[2] for r in runs), "<i4")
        w = np.frombuffer(b"".join(r[3] for r in runs), np.uint8 if u8 else "<f4")
        if len(runs) > 1 and (np.diff(d) < 0).any():
            order = np.argsort(d, kind="stable")
            d, w = d[order], w[order]
        yield t, d.tobytes(), w.tobytes()


def _write_part(folder: str, table: str, u8: bool):
    ddl, width = _ddl(table), len(_DDL[table])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not low:
                        low.append(r[0])
                    yield r

        file = f"{folder}/{uuid.uuid4().hex}.db"
        with sqlite3.connect(file) as db:
            db.execute("pragma journal_mode = off")
            db.execute(ddl)
            db.executemany(f"insert into {table} values ({', '.join('?' * width)})", _joined(rows(), u8) if table == "postings" else rows())
        db.close()
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([low[0] if low else None], pa.int64())], ["file", "low"])

    return run


def _ddl(table: str) -> str:
    return f"create table {table}({', '.join(f'{c} {kind}' for c, kind in _DDL[table].items())})"


def write_file(path: str, format_name: str, meta: dict[str, str], qlut: DataFrame, postings: DataFrame, docs: DataFrame) -> None:
    """Write a version 1 file. postings(term, doc_id, w) hold stored weights; docs have a deleted column."""
    if Path(path).exists():
        raise FileExistsError(path)
    u8 = meta.get("weight_mode", "u8") == "u8"
    folder = f"{path}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    runs = postings.select("term", "doc_id", "w").mapInArrow(_pack(u8), _RUNS)
    cols = ("id", "ext_id", "title", "body", "meta", F.col("deleted").cast("int"), "ntokens", F.col("truncated").cast("int"))
    parts = {"qlut": (qlut.select("term", "qw"), qlut.count(), ["term"]), "postings": (runs, postings.count(), ["t", "first"]), "docs": (docs.select(*cols), 4 * docs.count(), ["id"])}
    try:
        with sqlite3.connect(path) as db:
            for table in _DDL:
                db.execute(_ddl(table))
            db.execute("create index docs_deleted on docs(deleted) where deleted = 1")
            db.executemany("insert into meta values (?, ?)", sorted({**meta, "format": f"{format_name}/1"}.items()))
            db.commit()
            for table, (rows, n, order) in parts.items():
                rows = rows.repartitionByRange(-(-n // PART_ROWS) or 1, order[0]).sortWithinPartitions(*order)
                files = rows.mapInArrow(_write_part(folder, table, u8), "file string, low long").where("low is not null").orderBy("low").collect()
                for r in files:
                    db.execute("attach ? as part", (r["file"],))
                    db.execute(f"insert into main.{table} select * from part.{table} order by 1")
                    db.commit()
                    db.execute("detach part")
                    os.unlink(r["file"])
        db.close()
    finally:
        shutil.rmtree(folder, ignore_errors=True)

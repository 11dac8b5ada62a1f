"""How an index lies in a folder: Parquet tables and a manifest that names the current ones.

Every change writes new folders first and swaps the manifest last, by a rename. Readers hold the manifest they
opened, so a query sees one state throughout, and a write that fails leaves nothing but files nobody names.

postings are partitioned by tb = term mod BUCKETS and sorted by (term, doc_id), so a query reads only the folders
and row groups of its terms.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "impactspark/1"
BUCKETS = 16
#: Postings that a task sorts: at most, about, and at least where cores are left.
TASK_ROWS, LEAST_ROWS = 2_000_000, 50_000
#: Ids below 2 to this power go into one number with their term.
ID_BITS = 32
DOCS = "id long, ext_id string, title string, body string, meta string, ntokens int, truncated boolean"
PENDING = "id long, ext_id string, title string, body string"
TOMBSTONES = "id long"
VOCAB = "term int, token string"


def postings_schema(mode: str) -> str:
    return f"term int, doc_id long, w {'smallint' if mode == 'u8' else 'float'}, tb int"


@dataclass
class Manifest:
    meta: dict[str, str]
    generation: int = 0
    postings: list[str] = field(default_factory=list)
    docs: list[str] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)
    drained: int = 0
    queued: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    #: The layout by blocks of documents, and the tables of postings that it was made from.
    blocks: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)


class Store:
    """The files of one index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def full(self, name: str) -> str:
        """Where a table lies: in this folder, or, for a clone, where it was written."""
        return name if name.startswith("/") or ":/" in name else f"{self.path}/{name}"

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self) -> bool:
        return self._fs().exists(self._p("manifest.json"))

    def load(self) -> Manifest:
        fs = self._fs()
        stream = fs.open(self._p("manifest.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        m = Manifest(**json.loads(text))
        if m.meta.get("format") != FORMAT:
            raise ValueError(f"{self.path} is not a {FORMAT} database")
        if "vocab" in m.meta:
            # folders written before the vocabulary was a table: it becomes one, and the next commit says so
            tokens = json.loads(m.meta.pop("vocab"))
            rows = self.spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(tokens)), "array<string>")).alias("term", "token"))
            m.meta |= {"vocab_table": self.write(rows, "vocab"), "n_tokens": str(len(tokens))}
        return m

    def commit(self, m: Manifest) -> None:
        m.generation += 1
        fs = self._fs()
        new = f"manifest-{uuid.uuid4().hex}.tmp"
        out = fs.create(self._p(new), True)
        try:
            out.write(bytearray(json.dumps(asdict(m)).encode()))
        finally:
            out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._p("").toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._p(new), self._p("manifest.json"), options)

    def write(self, df: DataFrame, kind: str) -> str:
        """Write a table under a name of its own and return that name."""
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return name

    def write_postings(self, rows: DataFrame, n: int | None = None, top: int | None = None) -> str:
        """rows(term, doc_id, w): ranges of terms go to the same task, and a hot term's documents are spread by range too.

        n: how many rows there are, about, if known; a task then sorts TASK_ROWS of them, whatever their bytes come to.
        top: the greatest id, if known. Folder, term and id in one number are sorted by radix."""
        name = f"postings/{uuid.uuid4().hex}"
        out = rows.select("term", "doc_id", "w", F.pmod("term", F.lit(BUCKETS)).alias("tb"))
        parts = [] if n is None else [max(min(self.spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), -(-n // TASK_ROWS), 1)]
        order = ["tb", "term", "doc_id"]
        if top is not None and top < 1 << ID_BITS:
            # a term beyond 27 bits or an id that is not the index's would only be out of order
            order = [F.shiftleft(F.col("tb").cast("long"), 59).bitwiseOR(F.shiftleft(F.col("term").cast("long"), ID_BITS)).bitwiseOR(F.col("doc_id"))]
        out = out.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
        # a writer for each folder, or Spark would sort by folder once more
        conf, key = self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        kept = conf.get(key)
        conf.set(key, BUCKETS)
        try:
            out.write.mode("errorifexists").partitionBy("tb").parquet(f"{self.path}/{name}")
        finally:
            conf.set(key, kept)
        return name

    def read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.range(0).selectExpr(*(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")))
        parts = [self.spark.read.schema(schema).option("basePath", self.full(n)).parquet(self.full(n)) for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def delete(self, name: str) -> None:
        self._fs().delete(self._p(name), True)

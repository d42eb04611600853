"""What the training-data operators share: tables of an input folder and tables kept in the shared folder."""

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D], which part words.
BLANKS = " \t\n\x0b\x0c\r"
#: One word, for Java's and DuckDB's patterns.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a narrow table up to which it may be broadcast (some tens of MB); larger ones are shuffled.
SMALL = 1 << 18
#: Bytes of an Arrow batch between Spark and a Python worker, about; a batch has one row at least.
BATCH = 4 << 20
#: Rows of a narrow kept table in a file, about.
FILE = 1 << 16
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a folder of our own if all runs on this machine (tests)."""
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (kept.get() if kept.isDefined() else None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='loreforge-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, what: str, *by: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder, in folders by the columns named, and reads it back: cuts the lineage, and a lost executor costs no rows.
    rows: how many narrow rows it has, about; then no more tasks write it than these need, or two a core."""
    path = new_path(df.sparkSession, what)
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE)))
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(kept: DataFrame, rows: int | None = None) -> DataFrame:
    """A frozen narrow table for a join: with the hint to broadcast it if it has ``rows`` rows (SMALL) at most, else as it is, to be shuffled."""
    return F.broadcast(kept) if kept.count() <= (SMALL if rows is None else rows) else kept


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those that no column of df has (case aside)."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def in_arrow(rows: DataFrame, each, schema) -> DataFrame:
    """rows.mapInArrow, in batches of BATCH bytes: both sides hold a batch whole, outside the heap. Lowers the session's setting if it is larger."""
    conf = rows.sparkSession.conf
    number, unit = re.fullmatch(r"\s*(-?\d+)([kmgtp]?)b?\s*", conf.get(_BATCH).lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH:
        conf.set(_BATCH, f"{BATCH}b")
    return rows.mapInArrow(each, schema)


def slices(batches, rows: int = 512):
    """Arrow batches cut into small ones, so that what a task makes of one stays small. At its end the worker, which other tasks use again, gives back what it holds unused."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def give_back() -> None:
    """The memory that a worker holds unused, to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lower_ascii(text):
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_blanks(text):
    """text without any character of BLANKS; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out

"""Tables with declared schemas, and tables kept in the folder that the cluster shares."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def shared(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir, or in a folder of our own where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = own.get() if own.isDefined() else f"file://{tempfile.mkdtemp(prefix='loreforge-')}"
        spark.sparkContext.setCheckpointDir(at) if not own.isDefined() else None
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str = "kept") -> DataFrame:
    """df, written to the shared folder and reread. Files that were shuffled for it go with the write, not when the driver happens to collect its garbage."""
    path, conf = shared(df.sparkSession, what), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the folders of tables that :func:`keep` has written and df reads, once nothing reads them any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

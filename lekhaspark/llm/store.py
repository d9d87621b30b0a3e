"""Written tables in the shared folder of the cluster.

Intermediate results are cut by writing Parquet under spark.checkpoint.dir, so
a lost executor costs a re-read and never a recomputation from a local copy. All of an application stand in
one folder, which goes when its Python process ends, or with `drop_run`; what operators return may still read it until then."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Path -> what deletes it at the end.
_RUNS: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset on one machine (tests) a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-lekha-")
    return _OWN["dir"]


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    path = f"{shared_dir(spark)}/lekhaspark-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        _RUNS[path] = where, spark._jsc.hadoopConfiguration()
    return path


def drop_run(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application: nothing that an operator has returned can be read any more."""
    where, conf = _RUNS.pop(run_dir(spark))
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for where, conf in _RUNS.values():
        # the JVM may be gone already
        with contextlib.suppress(Exception):
            where.getFileSystem(conf).delete(where, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back: what follows starts from files that all executors share."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: all that was made from them is written itself."""
    for t in tables:
        remove(t.sparkSession, t.written_to)


#: Bits of a sieve: eight megabytes, whatever it was made of.
SIEVE_BITS = 1 << 26
_MAP_BITS = 1 << 15


def sieved(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """rows without most of those whose columns `on` equal no row of keys; none that equals one is lost. Keys are marked in a
    bitmap of a fixed size, the only thing that is broadcast; the more keys there are, the more other rows slip
    through. A join that follows shuffles little more than what it needs."""
    place = F.pmod(F.xxhash64(*on), F.lit(SIEVE_BITS))
    marked = keys.select(place.alias("p")).groupBy(F.expr(f"p div {_MAP_BITS}").alias("_map")).agg(F.bitmap_construct_agg(F.col("p") % _MAP_BITS).alias("_bits"))
    placed = rows.withColumn("_p", place).withColumn("_map", F.expr(f"_p div {_MAP_BITS}"))
    byte = f"cast(conv(hex(substring(_bits, cast(_p % {_MAP_BITS} div 8 + 1 as int), 1)), 16, 10) as int)"
    return placed.join(F.broadcast(marked), "_map").where(f"{byte} >> cast(_p % 8 as int) & 1 = 1").select(rows.columns)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (never null) only, so that other columns can bear any name."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

"""What several corpus operators share: the shared folder, partition counts, id ranges, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset (tests on one machine) a temporary folder is set as the checkpoint folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as Parquet under the shared folder; later reads do not depend on executors.

    The files are columnar and compressed, so they take a fraction of a checkpoint's serialized rows.
    They stay until the shared folder is cleared.
    """
    out = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``cut`` that nothing reads any more, and lets Spark delete the shuffle files it was made from.

    Spark drops those when the driver's memory is next tidied, which may be much later than the disk needs it.
    """
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    spark.sparkContext._jvm.System.gc()


#: ``small`` sends a table to every executor while it has at most so many values.
BROADCAST_VALUES = 1_000_000


def small(df: DataFrame, values: Column | None = None) -> DataFrame:
    """``df``, marked for broadcast if a count shows that it is small; else as it is, to be joined by shuffle.

    ``values`` says how many values a row has (1 if not given). ``df`` should be cut: it is read for the count.
    """
    n = df.agg(F.coalesce(F.sum(F.lit(1) if values is None else values), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if n <= BROADCAST_VALUES else df


def marked(rows: DataFrame, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """``rows`` with ``mark``, which tells rows that share an id apart: 0 where the id is alone, else a hash of the text."""
    repeated = cut(rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col))
    if repeated.isEmpty():
        return rows.withColumn("mark", F.lit(0).cast("bigint"))
    again = small(repeated).withColumn("again", F.lit(True))
    return rows.join(again, id_col, "left").withColumn("mark", F.when(F.col("again"), F.xxhash64(text_col)).otherwise(F.lit(0))).drop("again")


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """Ascending upper bounds of at most ``parts`` ranges of ``id_col``; each bound is an id that occurs.

    One approximate-quantile aggregate over the id column: what reaches the driver grows with the
    number of ranges, not with the rows. Empty for a table without ids.
    """
    steps = [i / parts for i in range(1, parts)]
    row = docs.agg(
        F.max(id_col).alias("top"),
        F.percentile_approx(id_col, F.lit(steps or [0.5]), F.lit(10_000)).alias("cuts"),
    ).first()
    if row.top is None:
        return []
    return sorted({int(x) for x in (row.cuts if steps else [])} | {int(row.top)})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` (bigint ids): rows ``(node, root)``.

    ``root`` is the smallest id that can be reached. Rounds of large-star and small-star (Kiveris
    et al., 2014): every round shuffles the edges once each way and keeps at most as many edges as
    before, no node gathers its neighbours in one row, and the rounds grow with the logarithm of
    the longest path. Each round is cut by a table in the shared folder.
    """
    cur = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        cur = cut(small)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    roots = cur.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select("root", "root").distinct().toDF("node", "root"))

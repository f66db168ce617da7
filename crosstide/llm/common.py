"""What the operators share: tables written once, and components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` stored once in the shared folder and read from there: later uses
    neither compute it again nor depend on an executor that may be lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Frees a query's shuffle files when the query ends, not when the driver next collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """As ``written``; the shuffle files of the write are freed at once, which the stored table makes needless."""
    conf = df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        return written(df, name, compression)
    finally:
        conf.unset(FREED) if before is None else conf.set(FREED, before)


def discard(df: DataFrame) -> None:
    """Deletes the stored table that ``df`` (made by ``written``) reads, after its last reader."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name where a column of ``df`` has it already (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def matched(left: DataFrame, right: DataFrame, on: str, how: str = "inner", sent: int = 1_500_000) -> DataFrame:
    """``left`` joined with ``right`` (narrow, one row per ``on``), which is counted first.

    Up to ``sent`` rows it is broadcast and ``left`` stays where it is; beyond
    that both are shuffled, and the engine splits what is skewed.
    """
    few = right.limit(sent + 1).count() <= sent
    return left.join(F.broadcast(right) if few else right, on, how)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key (the first ``keys`` columns) from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(keys)]
        start = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, start = [], key, i
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches, cut only where a key (the first ``keys`` columns of whole numbers) changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        last = [x[-1] for x in columns]
        cut = int(np.argmax(np.all([x == y for x, y in zip(columns, last, strict=True)], axis=0)))
        if cut or held and [held[-1].column(i)[-1].as_py() for i in range(keys)] != last:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition, reduced to one link per node to the smallest node it reaches there."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = up = above.get(up, up)
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                above[max(u, v)] = min(u, v)
    nodes = np.fromiter(above, dtype=np.int64, count=len(above))
    roots = np.fromiter((top(x) for x in list(above)), dtype=np.int64, count=len(above))
    for i in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 50_000]), pa.array(roots[i : i + 50_000])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of an undirected link table.

    ``links`` has two bigint columns; the result has ``node`` and ``component``
    (the smallest node reachable) for every node with a link to another one.
    NULL ends and loops are ignored; repeated links are harmless; no links give
    an empty table.

    Links are first reduced inside each partition, so a dense group costs one
    row per node and partition.  Then each round takes the smallest component
    among a node's neighbours, hands it to the node's old component, and jumps
    one step up; rounds grow with the logarithm of a component's diameter.
    Every round is written to the shared folder, and only a sum reaches the
    driver.
    """
    u, v = links.columns
    clean = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    tree = clean.mapInArrow(_forest, "u long, v long")
    both = written(tree.unionAll(tree.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    state = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "round")

    def total(df: DataFrame):
        return df.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]

    last, now = None, total(state)
    while now != last:
        near = both.join(state.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        met = state.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        hooks = met.select("node", "low").unionAll(met.where("low < component").select(F.col("component").alias("node"), "low"))
        lower = written(hooks.groupBy("node").agg(F.min("low").alias("up")), "hooks")
        up = lower.select(F.col("node").alias("up"), F.col("up").alias("component"))
        state = written(lower.join(up, "up").select("node", "component"), "round")
        last, now = now, total(state)
    return state

"""Trace folders, derived tables and tabular output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_trace(spark: SparkSession, path: str, tables: dict[str, str], views: bool = False) -> dict[str, DataFrame]:
    """The tables of a folder that has one ``<name>.parquet`` each. ``tables`` gives the wanted
    columns by table as DDL; columns a table lacks come as typed nulls, tables that aren't
    there are left out."""
    out = {}
    for name, ddl in tables.items():
        try:
            df = spark.read.parquet(f"{path}/{name}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        want = T.StructType.fromDDL(ddl)
        out[name] = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
        if views:
            out[name].createOrReplaceTempView(name)
    return out


def gpu_spans(tables: dict[str, DataFrame]) -> DataFrame:
    """Kernels, copies, fills and graphs as one table; what a kind lacks is null."""
    kinds = [k for k in ("kernel", "memcpy", "memset", "graph") if k in tables]
    out = tables[kinds[0]].withColumn("kind", F.lit(kinds[0]))
    for k in kinds[1:]:
        out = out.unionByName(tables[k].withColumn("kind", F.lit(k)), allowMissingColumns=True)
    return out


def resolve_names(df: DataFrame, strings: DataFrame, ids: tuple[str, ...] = ("demangled_id", "short_id"), missing: str = "<anonymous kernel>") -> DataFrame:
    """``name``: the first of the ids that the dictionary (id, value) knows."""
    for i in ids:
        df = df.join(strings.select(F.col("id").alias(i), F.col("value").alias(f"__{i}")), i, "left")
    return df.withColumn("name", F.coalesce(*[F.col(f"__{i}") for i in ids], F.lit(missing))).drop(*[f"__{i}" for i in ids])


def materialize(df: DataFrame, path: str, partition: tuple[str, ...] = (), order: tuple[str, ...] = ("start_ns",)) -> DataFrame:
    """Writes a derived table for reuse, sorted inside its files so that scans can skip."""
    order = tuple(c for c in order if c in df.columns)
    d = df.sortWithinPartitions(*partition, *order) if partition or order else df
    w = d.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def flatten_for_csv(df: DataFrame, map_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Nested columns with dots, maps as one column per key, arrays as JSON text."""
    cols = []

    def walk(name: str, col, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(f"{name}.{f.name}", col[f.name], f.dataType)
        elif isinstance(kind, T.MapType) and map_keys and name in map_keys:
            cols.extend(F.try_element_at(col, F.lit(k)).alias(f"{name}.{k}") for k in map_keys[name])
        elif isinstance(kind, (T.MapType, T.ArrayType)):
            cols.append(F.to_json(col).alias(name))
        else:
            cols.append(col.alias(name))

    for f in df.schema:
        walk(f.name, F.col(f"`{f.name}`"), f.dataType)
    return df.select(*cols)


def inventory(contexts: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Devices with their processes; with launch labels (rank variables) from key-value rows."""
    g = contexts.groupBy("device_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("process_id").cast("string"))), ",").alias("processes"), F.countDistinct("process_id", "context_id").alias("scopes"))
    if meta is None:
        return g
    ranks = meta.filter(F.col("key").rlike("(^|_)(LOCAL_|WORLD_|GLOBAL_)?RANK$")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "key", "value"))), ",").alias("labels"))
    return g.crossJoin(ranks)  # one row


def hardware(meta: DataFrame, keys: list[str]) -> DataFrame:
    """Key-value rows (entity, key, value) as one row per entity."""
    return meta.groupBy("entity").pivot("key", keys).agg(F.first("value"))

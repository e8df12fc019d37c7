"""Reading and writing models, captures, reports and labelled pictures."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import PROTOTYPES, TREE, WEIGHTS, Model


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared store; none where it isn't there."""
    store, where = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    store, where = _store(spark, path)
    store.delete(where, True)


def keep(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def forget(kept: DataFrame) -> None:
    """Delete what `keep` wrote; nothing may read it any more."""
    delete(kept.sparkSession, kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())


def _partitioned(df: DataFrame, layer: str, c: int, k: int) -> DataFrame:
    return df.select(F.lit(layer).alias("layer"), F.lit(c).alias("n_codebooks"), F.lit(k).alias("n_codes"), *df.columns)


def model_save(spark: SparkSession, model: Model, folder: str, layer: str) -> None:
    """The model's tables, partitioned by layer and size; other partitions stay."""
    for name, df in (("tree", model.tree(spark)), ("prototypes", model.prototype_table(spark)), ("weights", model.weight_table(spark))):
        out = _partitioned(df, layer, model.codebooks, model.codes)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "n_codebooks", "n_codes").parquet(f"{folder}/{name}")


def model_writeback(spark: SparkSession, model: Model, folder: str, layer: str) -> None:
    """Replace only the prototypes of a stored model."""
    out = _partitioned(model.prototype_table(spark), layer, model.codebooks, model.codes)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "n_codebooks", "n_codes").parquet(f"{folder}/prototypes")


def model_load(spark: SparkSession, folder: str, layer: str, codebooks: int, codes: int) -> Model:
    """A whole model back; partition filters reach the scan, and the rows are model-sized."""

    def rows(name: str, schema: str) -> list:
        columns = [f.split()[0] for f in schema.split(", ")]
        t = spark.read.parquet(f"{folder}/{name}").where((F.col("layer") == layer) & (F.col("n_codebooks") == codebooks) & (F.col("n_codes") == codes))
        return t.select(*columns).collect()

    tree = rows("tree", TREE)
    if not tree:
        raise ValueError(f"no model of {layer} with {codebooks} x {codes} codes")
    depth = codes.bit_length() - 1
    dims = {(r["c"], r["level"]): r["dim"] for r in tree}
    cuts = {(r["c"], (1 << r["level"]) - 1 + r["node"]): r["threshold"] for r in tree}
    weights: dict[int, dict[int, float]] = {}
    for r in rows("weights", WEIGHTS):
        weights.setdefault(r["m"], {})[r["dim"]] = r["w"]
    return Model(
        tuple(tuple(dims[c, l] for l in range(depth)) for c in range(codebooks)), tuple(tuple(cuts[c, n] for n in range(codes - 1)) for c in range(codebooks)),
        {(r["c"], r["k"], r["dim"]): r["value"] for r in rows("prototypes", PROTOTYPES)}, tuple(tuple(v for _, v in sorted(weights[m].items())) for m in sorted(weights)),
    )


def write_reports(df: DataFrame, folder: str, kind: str = "json") -> None:
    writer = df.write.mode("overwrite")
    writer.json(folder) if kind == "json" else writer.option("header", True).csv(folder)


def scan_run_reports(spark: SparkSession, folder: str, pattern: str = ".*") -> DataFrame:
    """All JSON reports whose layer matches, with the file each came from."""
    return spark.read.json(folder).withColumn("file", F.input_file_name()).where(F.col("layer").rlike(pattern))


def scan_labelled_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, label, length, content) of a folder per class; decoding is the caller's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"), "length", "content")


def write_capture(rows: DataFrame, folder: str, worker: int) -> None:
    """One worker's captured rows as a file set of their own; written again, they replace themselves."""
    rows.write.mode("overwrite").parquet(f"{folder}/worker={worker}")


def merge_captures(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all workers, stacked, with the worker each row came from."""
    return spark.read.option("basePath", folder).option("mergeSchema", True).parquet(folder)

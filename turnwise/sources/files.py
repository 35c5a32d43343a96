"""JSON, JSON lines and parquet files in and out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.text import normalized_json, normalized_keeping_symbols
from turnwise.operators.sampling import sample_of


def read_records(spark: SparkSession, folder: str, schema: T.StructType, corrupt: str = "_corrupt") -> DataFrame:
    """All .json files (an array or one object each) and .jsonl files (an object a line) below a folder, with their file and a `_corrupt` column.

    The two kinds need two reads: in multi-line mode only the first line of a .jsonl file would be kept. A missing
    kind gives no rows. Other files are left alone."""
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])

    def read(pattern: str, lines: bool) -> DataFrame:
        r = spark.read.schema(full).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
        return r.option("multiLine", not lines).json(folder).withColumn("file", F.col("_metadata.file_path"))

    return read("*.json", False).unionByName(read("*.jsonl", True))


def write_lines(df: DataFrame, path: str, mode: str = "append", *partitions: str) -> None:
    """JSON lines; partitioned by columns where given."""
    w = df.write.mode(mode)
    (w.partitionBy(*partitions) if partitions else w).json(path)


def read_tables(spark: SparkSession, *paths: str, columns: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> DataFrame:
    """Parquet files one below the other; optional columns that are missing become null. Nested columns are named with dots."""
    df = None
    for p in paths:
        part = spark.read.parquet(p)
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    if columns or optional:
        have = set(df.columns)
        df = df.select(*[F.col(c).alias(c.replace(".", "_")) for c in columns], *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in optional])
    return df


def rl_rows(samples: DataFrame, split: str, source: str) -> DataFrame:
    """Samples (index, instruction, input, output) in the shape of reinforcement-learning parquet rows."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return samples.select(
        F.lit(source).alias("data_source"), F.array(message("system", "instruction"), message("user", "input")).alias("prompt"), F.lit("dialogue").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("output").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), "instruction", F.col("index").cast("long").alias("index"), "input", "output").alias("extra_info"),
    )


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each value of `split`."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def with_responses(rows: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """`rows` with `responses`: the texts (key, sample_no, text) of each key in order of sample_no."""
    lists = responses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sample_no", "text"))).alias("x")).select(key, F.transform("x", lambda x: x["text"]).alias("responses"))
    return rows.join(lists, key, "left")


def catalogue_groups(tools: DataFrame) -> DataFrame:
    """tag, n_tools, names (sorted) of a flat tool table (name, category)."""
    return tools.groupBy(F.col("category").alias("tag")).agg(F.count("*").alias("n_tools"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def read_array_or_object(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of one JSON file: an array's elements, or one object. Files of other kinds are an error."""
    if not path.endswith((".json", ".jsonl")):
        raise ValueError(f"{path} is neither .json nor .jsonl")
    return spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)


def cleaned(df: DataFrame) -> DataFrame:
    """Every text leaf of every column in plain form; columns without texts are left alone."""
    out = []
    for f in df.schema.fields:
        if "string" not in f.dataType.simpleString():
            out.append(F.col(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(normalized_keeping_symbols(f.name).alias(f.name))
        else:
            out.append(F.from_json(normalized_json(F.to_json(f.name)), f.dataType.simpleString() if not isinstance(f.dataType, T.StructType) else f.dataType).alias(f.name))
    return df.select(*out)


def read_cleaned(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """`read_records` without corrupt rows, all texts in plain form."""
    return cleaned(read_records(spark, folder, schema).where("_corrupt IS NULL").drop("_corrupt", "file"))


def progress(spark: SparkSession, folder: str, schema: T.StructType, files: int = 100, name: str = "generated_multi_turn_{}.jsonl") -> DataFrame:
    """The snapshots of an earlier run: those of its numbered files that exist; none gives no rows."""
    found = [p for p in (f"{folder}/{name.format(k)}" for k in range(files)) if exists(spark, p)]
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)


def read_samples(spark: SparkSession, *paths: str, key: str, most: int = -1, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """Parquet files one below the other: all rows, or at most so many, the first by key or those of a seeded draw."""
    return sample_of(read_tables(spark, *paths), key, most, shuffle, seed)


def evaluation_rows(spark: SparkSession, *paths: str, prompt: str = "prompt", responses: str = "responses", source: str = "data_source", gold: str = "reward_model.ground_truth") -> DataFrame:
    """prompt, responses, data_source, gold of parquet files whose columns (nested ones with dots) the caller names."""
    df = read_tables(spark, *paths)
    return df.select(F.col(prompt).alias("prompt"), F.col(responses).alias("responses"), F.col(source).alias("data_source"), F.col(gold).alias("gold"))


def preferences(spark: SparkSession, *paths: str) -> DataFrame:
    """prompt, chosen, rejected of parquet files."""
    return read_tables(spark, *paths, columns=("prompt", "chosen", "rejected"))


def side_by_side(original: DataFrame, inference: DataFrame, pos: str = "pos", only: tuple[int, ...] = ()) -> DataFrame:
    """Rows of two numbered tables beside each other, all or those at the given numbers; clashing names of the second get a suffix."""
    names = [f"{c}_inference" if c in original.columns and c != pos else c for c in inference.columns]
    both = original.join(inference.toDF(*names).hint("merge"), pos)
    return both.where(F.col(pos).isin(*only)) if only else both


def dump_generations(rows: DataFrame, path: str) -> None:
    """JSON lines of generations, one folder for each step."""
    write_lines(rows, path, "append", "step")


def log_metrics(metrics: DataFrame, path: str, step: int, console: bool = False) -> None:
    """A line of step and data (name to value) in a log of JSON lines, and on the console where asked for; metrics are few."""
    row = metrics.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("data")).select(F.lit(step).alias("step"), "data")
    write_lines(row, path)
    if console:
        print(step, dict(metrics.select("name", "value").limit(1000).collect()))


def sample_table(previous: DataFrame | None, samples: DataFrame, step: int) -> DataFrame:
    """The samples of all steps so far, one below the other."""
    now = samples.withColumn("step", F.lit(step))
    return now if previous is None else previous.unionByName(now, allowMissingColumns=True)


# ---- file systems ------------------------------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)


def copy(spark: SparkSession, source: str, target: str, again: bool = False) -> str:
    """A copy on any file system that Spark reaches; one that is there already is kept unless asked for again."""
    (a, from_), (b, to) = _path(spark, source), _path(spark, target)
    if again or not to.exists(b):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_, a, to, b, False, True, spark._jsc.hadoopConfiguration())
    return target


def cache_name(path: str, folder: str) -> str:
    """Where a copy of a remote path belongs: under the digest of its parent, by its own name."""
    head, _, tail = path.rstrip("/").rpartition("/")
    return f"{folder}/{hashlib.md5(head.encode()).hexdigest()}/{tail}"


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def computed_once(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path; where there is none, it is computed and written first. The path names what it depends on."""
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

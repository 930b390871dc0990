"""Readers. A malformed record is an error, a skipped row or a null, as each source defines; rules are checked in Spark, and only violations (a few) reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


class BadInput(ValueError):
    """An input breaks its contract."""


def jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """Records of JSON lines; blank lines are no records."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task records with three fields that are not blank and unique ids; none at all is an error."""
    rows = jsonl(spark, path, schemas.TASK)
    blank = F.lit(False)
    for c in ("task_id", "prompt", "hidden_tests"):
        blank = blank | F.col(c).isNull() | (F.trim(c) == "")
    bad = rows.groupBy("task_id").agg(F.count("*").alias("n"), F.bool_or(blank).alias("blank"))
    seen = bad.agg(F.count("*").alias("ids"), F.max(F.when(F.col("blank") | (F.col("n") > 1), F.coalesce("task_id", F.lit("")))).alias("worst")).first()
    if not seen["ids"]:
        raise BadInput("no tasks")
    if seen["worst"] is not None:
        raise BadInput(f"task {seen['worst']!r} is repeated or has a blank field")
    return rows


def _evalplus(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.EVALPLUS, "DROPMALFORMED").filter("task_id is not null")


def humaneval(spark: SparkSession, path: str) -> DataFrame:
    """The solution is the prompt and its continuation."""
    return _evalplus(spark, path).withColumn("canonical_solution", F.concat("prompt", "canonical_solution"))


def mbpp(spark: SparkSession, path: str) -> DataFrame:
    """S3: the solution stands alone."""
    return _evalplus(spark, path)


def apps(spark: SparkSession, path: str, tiers: list[str] | None = None) -> DataFrame:
    """Problems, of some tiers in any case."""
    from ..operators.sampling import of_tiers

    rows = jsonl(spark, path, schemas.APPS, "DROPMALFORMED").filter("problem_id is not null")
    return of_tiers(rows, tiers) if tiers else rows


READERS = {"humaneval": humaneval, "humanevalplus": humaneval, "mbpp": mbpp, "mbppplus": mbpp, "apps": apps, "appsplus": apps}


def benchmark(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The benchmark of a name or alias, in any spelling with + or -."""
    key = "".join(c for c in name.lower().replace("+", "plus") if c.isalnum())
    if key not in READERS:
        raise BadInput(f"unknown benchmark {name!r}")
    return READERS[key](spark, path)


def problem_list(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Id, title and tier of all problems; malformed rows are skipped."""
    out = None
    for name, path in paths.items():
        rows = benchmark(spark, name, path)
        one = rows.select(F.col("problem_id").alias("id"), F.col("prompt").alias("title"), F.col("difficulty").alias("tier")) if "problem_id" in rows.columns else rows.select(F.col("task_id").alias("id"), F.coalesce("entry_point", "task_id").alias("title"), F.lit(None).cast("string").alias("tier"))
        one = one.withColumn("benchmark", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def experiment_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three experiment tables, from Parquet; with a database driver on the class path, ``jdbc_table`` reads them where they are."""
    return {t: spark.read.parquet(f"{folder}/{t}") for t in ("experiment_runs", "problem_runs", "problem_rounds")}


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table of a database, read in parallel over ranges of a number if one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a generation cache with its header; broken JSON, no entries, or repeated ids are errors."""
    doc = spark.read.schema(schemas.CACHE + ", _corrupt_record string").option("multiLine", True).json(path)
    heads = doc.agg(F.count("*").alias("n"), F.bool_or(F.col("_corrupt_record").isNotNull()).alias("corrupt"), F.bool_or(F.col("entries").isNull() | F.col("schema").isNull()).alias("none")).first()
    if not heads["n"] or heads["corrupt"]:
        raise BadInput("the cache is not JSON of its schema")
    if heads["none"]:
        raise BadInput("the cache lacks its structure")
    rows = doc.select("model", "dataset_sha256", F.explode("entries").alias("e")).select("model", "dataset_sha256", "e.*")
    again = rows.groupBy("task_id").count().filter("count > 1 or task_id is null").limit(1).collect()
    if again:
        raise BadInput(f"task {again[0]['task_id']!r} is repeated in the cache")
    return rows


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file with its path; files that hold none are left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    parsed = text.withColumn("v", F.when(F.col("value").rlike(r"\A\s*\{"), F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})))
    return parsed.filter("v is not null and v._corrupt_record is null").select("file", "modified", "v.*").drop("_corrupt_record")


def datasets(spark: SparkSession, folder: str, names: str = "*.jsonl") -> DataFrame:
    """Top-level JSON-lines files by name: lines that are not blank, and SHA-256 of the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    lines = F.size(F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: F.trim(x) != ""))
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), lines.cast("long").alias("tasks")).orderBy("name")


def caches(spark: SparkSession, folder: str) -> DataFrame:
    """Caches whose header is whole, by file name."""
    rows = objects(spark, f"{folder}/*.json", schemas.CACHE)
    ok = F.col("dataset_sha256").rlike(r"\A[0-9a-f]{64}\z") & F.col("model").isNotNull() & F.col("llm_mode").isin("live", "mock") & F.col("generation_prompt_style").isNotNull()
    return rows.filter(ok).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "model", "dataset_sha256", "llm_mode", F.size("entries").alias("entries")).orderBy("name")


def suites(spark: SparkSession, lines: DataFrame, folder: str) -> DataFrame:
    """Each record line with the suite whose name is the hash of the line; a missing one is an error when it is read."""
    files = spark.read.text(f"{folder}/*.py", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([0-9a-f]{64})\.py$", 1).alias("h"), F.col("value").alias("suite"))
    j = lines.withColumn("h", F.sha2("line", 256)).join(files, "h", "left")
    return j.withColumn("suite", F.coalesce("suite", F.raise_error(F.concat(F.lit("no suite "), "h")).cast("string")))


def counted(rows: DataFrame, expected: int) -> DataFrame:
    """Rows, if there are as many as expected; compressed JSON lines are read as they are."""
    if (n := rows.count()) != expected:
        raise BadInput(f"{n} rows; {expected} were expected")
    return rows


def synthetic(spark: SparkSession, n: int = 140) -> DataFrame:
    """Rows of a fixed shape for when a download fails."""
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("rwpb/"), i).alias("task_id"), F.concat(F.lit("Return the number "), i, F.lit(" added to x.")).alias("prompt"), F.concat(F.lit("def f(x):\n    return x + "), i).alias("canonical_solution"))


#: Folders that hold no sources.
SKIPPED = ("__pycache__", "node_modules", "venv", "build", "dist")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Python files under a folder with their module names, without hidden and named folders, by path.

    Spark's own readers pass over names like ``__init__.py``, so the driver lists the names and the executors read the files.
    """
    import re

    import pyarrow as pa
    from pyarrow import fs

    def store():
        if folder.startswith("file:") or "://" not in folder:
            return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").strip("/")
        return fs.FileSystem.from_uri(folder)

    system, root = store()
    names = [f.path[len(root) :].lstrip("/") for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".py")]
    names = [n for n in sorted(names) if not any(p.startswith(".") or p in SKIPPED for p in n.split("/"))]
    modules = [(n, re.sub(r"(/__init__)?\.py$", "", n).replace("/", ".")) for n in names]

    def read(batches):
        own, top = store()
        for b in batches:
            texts = [own.open_input_stream(f"{top}/{n}").read().decode("utf-8", "replace") for n in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], ["path", "module", "content"])

    return spark.createDataFrame(modules, "path string, module string").mapInArrow(read, "path string, module string, content string").orderBy("path")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an append-only log; blank, broken and cut-off lines are none. ``ord`` is the order of writing: files as they were written, then places in them."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.withColumn("v", F.from_json("value", schemas.TRAJECTORY)).filter("v.task_id is not null")
    return parsed.select(F.struct("modified", "file", "block", "at").alias("ord"), "v.*")

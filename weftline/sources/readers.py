"""Reading records from files, with faults as rows instead of failures."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = {".jsonl": "json", ".json": "json", ".parquet": "parquet", ".csv": "csv"}

COMMIT = "old_file string, new_file string, old_contents string, new_contents string, subject string"
REQUEST = "custom_id string, user_prompt string, max_tokens bigint"
RESPONSE = "custom_id string, response struct<body:struct<choices:array<struct<index:int,message:struct<content:string>>>>>"
JUDGED = "custom_id string, language string, original_code string, update_snippet string, final_code string, judge_result string, judge_content string"
TRAINING = "data_source string, prompt array<struct<role:string,content:string>>, reward_model struct<style:string,ground_truth:string>, extra_info struct<split:string,index:bigint,original_code:string,update_snippet:string,language:string>"
PREDICTION = "index bigint, prediction string, elapsed_time double, ground_truth string, original_code string, update_snippet string, language string"


def load(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """JSON lines (blank lines skipped, a bad line fails), Parquet or CSV by the ending; else ValueError."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind is None:
        raise ValueError(f"no reader for {path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "json":
        return reader.option("mode", "FAILFAST").json(path)
    return reader.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path) if kind == "csv" else reader.parquet(path)


def name_variants(language: str) -> list[str]:
    """The names under which the files of a language are looked for."""
    return list(dict.fromkeys([language, language.lower(), language.upper(), language.replace("+", "plus"), language.replace("#", "sharp")]))


def discover(spark: SparkSession, root: str, language: str) -> list[str]:
    """The files of a language below ``root``, sorted; names only are listed, on the driver."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {f"{v}{e}" for v in name_variants(language) for e in FORMATS}
    found, it = set(), fs.listFiles(base, True)
    while it.hasNext():
        path = it.next().getPath()
        if path.getName() in names:
            found.add(path.toString())
    return sorted(found)


def load_all(spark: SparkSession, paths: Iterable[str], schema: str | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """S3: the union of all files that can be read to their last line, and the error of each other one.

    A file that can't be opened shows at once. Bad lines of JSON files, wherever
    they stand, are counted by one job over all of them; such a file is left out
    as a whole.
    """
    frames, errors = {}, {}
    for path in paths:
        try:
            frames[path] = load(spark, path, schema)
        except Exception as e:
            errors[path] = str(e).split("\n")[0]
    texts = [path for path in frames if FORMATS[os.path.splitext(path.rstrip("/"))[1].lower()] == "json"]
    if texts:
        value = F.try_parse_json("value")
        rows = spark.read.text(texts).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), value.isNull().alias("bad"))
        bad = {r.file: r.n for r in rows.where("bad").groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as files at most
        for path in texts:
            n = sum(k for file, k in bad.items() if _same_place(file, path))
            if n:
                errors[path] = f"{n} lines are no JSON"
                del frames[path]
    out = None
    for df in frames.values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, errors


def _same_place(file: str, path: str) -> bool:
    """Whether a file, as Spark names it, is ``path`` or lies in it."""
    bare = lambda p: re.sub(r"^file:/+", "/", unquote(p)).rstrip("/")
    return bare(file) == bare(path) or bare(file).startswith(bare(path) + "/")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no`` and ``line`` of non-blank lines; the first line without a byte order mark.

    Line numbers count from 1 in each file. Each block of a file is numbered by
    itself and shifted by the lines of the blocks before, so a large file is
    numbered in as many tasks as it has blocks.
    """
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("line"))
    sizes = df.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    shifts = sizes.withColumn("before", F.expr("coalesce(sum(n) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0)"))
    inside = F.expr("row_number() over (partition by file, block order by at)")
    numbered = df.withColumn("nth", inside).join(shifts.select("file", "block", "before"), ["file", "block"])
    return numbered.where(F.trim("line") != "").select("file", (F.col("nth") + F.col("before")).alias("line_no"), "line")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line as a record with ``line_no`` and ``error``: a parse error or a value that is no object."""
    v = F.try_parse_json("line")
    kind = F.schema_of_variant(v)
    rows = lines(spark, path).withColumn("error", F.when(v.isNull(), "input_json_parse_error").when(~kind.startswith("OBJECT"), "input_json_not_object"))
    return rows.withColumn("r", F.when(F.col("error").isNull(), F.from_json("line", schema))).select("file", "line_no", "error", "r.*")


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def splits(spark: SparkSession, **paths: str) -> DataFrame:
    """Files of several splits as one table with ``split``; every file must exist."""
    out = None
    for name, path in paths.items():
        df = load(spark, path).withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Training rows as flat samples; a missing field is an error; ``index`` falls back to the position in the file.

    The position is the row of a Parquet file, or counts the non-blank lines of a JSON file, from 0.
    """
    if path.endswith(".parquet"):
        df = load(spark, path).withColumn("_at", F.col("_metadata.row_index"))
    else:
        rows = lines(spark, path)
        blocks = F.expr("row_number() over (partition by file, range order by line_no)")
        rows = rows.withColumn("range", F.floor(F.col("line_no") / 1_000_000)).withColumn("nth", blocks)
        before = rows.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.expr("coalesce(sum(n) over (partition by file order by range rows between unbounded preceding and 1 preceding), 0)"))
        df = rows.join(before.select("file", "range", "before"), ["file", "range"]).select(F.from_json("line", TRAINING, {"mode": "FAILFAST"}).alias("r"), (F.col("nth") + F.col("before") - 1).alias("_at")).select("r.*", "_at")
    for c in ("extra_info", "reward_model"):
        if c not in df.columns:
            raise KeyError(c)
    e = df.schema["extra_info"].dataType.fieldNames()
    for c in ("original_code", "update_snippet", "language"):
        if c not in e:
            raise KeyError(c)
    index = F.coalesce(F.col("extra_info.index") if "index" in e else F.lit(None).cast("long"), F.col("_at").cast("long"))
    return df.select(index.alias("index"), "extra_info.original_code", "extra_info.update_snippet", "extra_info.language", "reward_model.ground_truth")


def results(spark: SparkSession, path: str, method: str) -> DataFrame:
    """The failed ids per file of a result document; an unknown method is an error."""
    entry = "map<string,struct<language:string,errors_list:array<bigint>,Accuracy:double>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{entry}>").alias("m"))
    part = doc.select(F.col("m").getItem(method).alias("files")).where(F.col("files").isNotNull())
    if not part.take(1):
        raise KeyError(method)
    return part.select(F.explode("files").alias("file", "r")).select("file", "r.language", "r.errors_list", F.col("r.Accuracy").alias("accuracy"))


def newest_first(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``file``, ``language`` (from its name) and ``modified`` of prediction files, the newest first."""
    from ..functions.text import file_language

    meta = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return meta.select(F.col("path").alias("file"), name.alias("name"), file_language(name).alias("language"), F.col("modificationTime").alias("modified")).where(F.col("name").startswith(prefix)).orderBy(F.desc("modified"), "file")


def labelled(names: list[str], aliases: dict[str, str]) -> dict[str, str]:
    """A label for each judged file: an exact alias, else the longest alias it begins with, else its stem; two files with one label are an error."""
    out: dict[str, str] = {}
    for name in names:
        stem = os.path.splitext(os.path.basename(name))[0]
        exact = next((aliases[k] for k in (name, os.path.basename(name), stem, stem.removesuffix("_judged")) if k in aliases), None)
        begins = sorted((k for k in aliases if stem.startswith(k)), key=len)
        label = exact or (aliases[begins[-1]] if begins else stem)
        if label in out.values():
            raise ValueError(f"two files are labelled {label}")
        out[name] = label
    return out


def bounded(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``key``; 0 for all."""
    return df.orderBy(key).limit(n) if n else df

"""JSONL / JSON-array sources (A-01 ... A-10).

Lines are read with the text source (splittable, one row per line), validated with
Catalyst JSON functions and parsed against a declared schema — never inferred. The load
order of a line is ``(file_index, _metadata.file_block_start, position in the split)``:
all lines of one split sit in one partition in file order, so this orders lines exactly as
they appear in their file without a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import CONSOLIDATE_NO_REASON as NO_REASON
from ..functions.text import py_strip
from ..operators.replies import strict_json
from ..operators.rows import keep_if, sealed

DETECTED_RECORD = T.StructType([
    T.StructField("recordId", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("PIIs", T.ArrayType(T.StringType())),
])

ENTITY_RECORD = T.StructType([
    T.StructField("recordId", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("entityType", T.StringType()),
    T.StructField("entityValue", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

REASONING_RESULT = T.StructType([
    T.StructField("recordId", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("detected_piis", T.ArrayType(T.StringType())),
    T.StructField("verified_piis", T.ArrayType(T.StructType([
        T.StructField("pii", T.StringType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("reason", T.StringType())]))),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("model", T.StringType()),
])

CATALOGUE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
])


def _exists(spark: SparkSession, path: str) -> bool:
    """File-system metadata check through Hadoop (works for local, HDFS and object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p)) if any(c in path for c in "*?[") else fs.exists(p)


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """A-07: drop nonexistent paths; error only when none is left."""
    kept = [p for p in paths if _exists(spark, p)]
    if not kept:
        raise FileNotFoundError(f"No input files found: {paths}")
    return kept


def _entries(spark: SparkSession, paths: list[str]) -> list[tuple[int, str, bool]]:
    """(place, full path, is a folder) of what each input names, in order; globs in the order of their names."""
    jvm = spark.sparkContext._jvm
    out = []
    for place, path in enumerate(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted((str(s.getPath()), bool(s.isDirectory())) for s in (fs.globStatus(p) or []))
        out += [(place, full, folder) for full, folder in found]
    return out


def _origin(entries: list[tuple[int, str, bool]]) -> Column:
    """Which entry a line comes from, by its column ``_path``."""
    path = F.col("_path")
    files = [(full, i) for i, (_, full, folder) in enumerate(entries) if not folder]
    index = F.lit(len(entries))
    for i, (_, full, folder) in reversed(list(enumerate(entries))):
        if folder:
            index = F.when(F.startswith(path, F.lit(full.rstrip("/") + "/")), F.lit(i)).otherwise(index)
    if files:
        first = {}
        for full, i in files:
            first.setdefault(full, i)
        # one lookup, however many files
        index = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), path), index)
    return index


def _path() -> Column:
    """A line's file as the file system names it."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^file:/+", "file:/")


def _load_order(entries: list[tuple[int, str, bool]]) -> Column:
    """Order of a line: its input entry's place (a file, or a folder that holds it), then file and position."""
    return F.struct(
        _origin(entries).alias("file_index"),
        F.col("_file_name").alias("file_name"),
        F.col("_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("pos"))


def _tag(entries: list[tuple[int, str, bool]]) -> Column:
    """A-08: the file's stem; that of its folder where the folder is named like a result file."""
    names = [full.rstrip("/").rsplit("/", 1)[-1] if folder and full.rstrip("/").endswith(".jsonl") else None
             for _, full, folder in entries]
    name = F.col("load_order.file_name")
    if any(names):
        name = F.coalesce(F.get(F.array(*[F.lit(n).cast("string") for n in names]), F.col("load_order.file_index")), name)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType = DETECTED_RECORD,
               required: tuple[str, ...] = ("recordId", "input"), rejects: bool = False,
               ignore_missing: bool = False, keep_variant: bool = False) -> DataFrame:
    """A-01/A-02/A-07/A-08: tolerant JSONL scan.

    Blank lines are skipped; a line that is not exactly one JSON value is rejected as
    ``invalid_json``; an object lacking a required key is rejected as ``missing_<key>``
    (keys tested in order); a key present with a null value is kept. Output: the schema's
    columns plus ``model_tag`` (file stem), ``load_order`` and, with ``rejects=True``, all
    lines with ``reject_reason`` and ``raw_line`` instead of only the kept ones.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if ignore_missing:
        paths = existing_paths(spark, paths)
    entries = _entries(spark, paths)
    # the path, the stripped line and the verdict on it are columns that nothing is pushed below, so each is computed once a line
    raw = spark.read.text(paths).select(
        F.col("value").alias("raw_line"), _path().alias("_path"), F.col("_metadata.file_name").alias("_file_name"),
        F.col("_metadata.file_block_start").alias("_block_start")).select("raw_line", _load_order(entries).alias("load_order"))
    line = py_strip(F.col("raw_line"))
    lines = keep_if(raw.select("raw_line", "load_order", line.alias("line")), lambda r: r["line"] != "")
    valid = strict_json(F.col("line")).isNotNull()
    keys = F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>"))
    reason = F.when(~valid, F.lit("invalid_json"))
    for k in required:
        reason = reason.when(~F.array_contains(keys, k), F.lit(f"missing_{k}"))
    judged = sealed(lines.select("raw_line", "load_order", "line", reason.alias("reject_reason")))
    kept = F.col("reject_reason").isNull()
    parsed = judged.select(
        "raw_line", "load_order", "reject_reason", F.when(kept, F.from_json("line", schema)).alias("rec"),
        *([F.when(kept, F.try_parse_json("line")).alias("json")] if keep_variant else []))
    out = parsed.select(
        *[F.col(f"rec.{f.name}").alias(f.name) for f in schema.fields],
        _tag(entries).alias("model_tag"),
        "load_order", "reject_reason", "raw_line", *(["json"] if keep_variant else []))
    if rejects:
        return out
    return out.filter(F.col("reject_reason").isNull()).drop("reject_reason", "raw_line")


ENTITY_RESULT = T.StructType([
    T.StructField("recordId", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("entityType", T.StringType()),
    T.StructField("entityValue", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("verified", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("latencyMs", T.DoubleType())])),
    T.StructField("model", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("parameters", T.StringType())])),
    T.StructField("timestamp", T.TimestampNTZType()),
])

RESULT_ITEM = "struct<pii:string,verified:boolean,reason:string>"


def read_results(spark: SparkSession, paths: str | list[str], ignore_missing: bool = True) -> DataFrame:
    """A-07/C-06: reasoning-mode result files for consolidation.

    ``verified_piis`` is read item by item from the parsed line: object items become
    struct(pii, verified, reason), anything else (strings of simple mode, numbers, a non-list
    value) is ignored, so one stray item never drops the others. Keys that an item lacks take their
    defaults (C-05); an explicit null stays null.
    """
    base = T.StructType([f for f in REASONING_RESULT.fields if f.name != "verified_piis"])
    df = read_jsonl(spark, paths, base, required=(), ignore_missing=ignore_missing, keep_variant=True)

    def value(x: Column, key: str, kind: str, default) -> Column:
        missing = F.try_variant_get(x, f"$.{key}", "variant").isNull()
        return F.when(missing, F.lit(default)).otherwise(F.try_variant_get(x, f"$.{key}", kind)).alias(key)
    items = F.transform(
        F.filter(F.try_variant_get("json", "$.verified_piis", "array<variant>"),
                 lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))),
        lambda x: F.struct(value(x, "pii", "string", ""), value(x, "verified", "boolean", False),
                           value(x, "reason", "string", NO_REASON)))
    return df.withColumn("verified_piis", F.coalesce(items.cast(f"array<{RESULT_ITEM}>"),
                                                     F.array().cast(f"array<{RESULT_ITEM}>"))).drop("json")


def read_entity_results(spark: SparkSession, results_dir: str) -> DataFrame:
    """A-06 into E-09: all ``*.jsonl`` of a folder as the long view that ``stats`` reads.

    Columns: file (its place by name), file_name, model (name, type, parameters), record_id, latency_ms,
    confidence, verified, ts, load_order.
    """
    rows = read_results_dir(spark, results_dir, ENTITY_RESULT)
    if "load_order" not in rows.columns:        # a folder without result files
        return spark.createDataFrame([], "file int, file_name string, model struct<name:string,type:string,parameters:string>, "
                                         "record_id string, latency_ms double, confidence double, verified boolean, "
                                         "ts timestamp_ntz, load_order struct<file_index:int,file_name:string,block_start:bigint,pos:bigint>")
    return rows.select(
        F.col("load_order.file_index").alias("file"), F.col("model_tag").alias("file_name"), "model",
        F.col("recordId").alias("record_id"), F.col("result.latencyMs").alias("latency_ms"),
        F.col("result.confidence").alias("confidence"), F.col("result.verified").alias("verified"),
        F.col("timestamp").alias("ts"), "load_order")


def count_nonblank(spark: SparkSession, path: str | list[str]) -> int:
    """A-03: non-blank line count (invalid lines included)."""
    return spark.read.text(path).filter(py_strip(F.col("value")) != "").count()


def read_jsonl_strict(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """A-05: strict load — the first malformed line aborts the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_results_dir(spark: SparkSession, results_dir: str, schema: T.StructType) -> DataFrame:
    """A-06: every ``*.jsonl`` of a directory (empty files add no rows); missing dir errors.

    Files are ordered by name (the reference's glob order is unspecified)."""
    if not _exists(spark, results_dir):
        raise FileNotFoundError(f"Results directory not found: {results_dir}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(results_dir.rstrip("/") + "/*.jsonl")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(str(s.getPath()) for s in (fs.globStatus(p) or []))
    if not files:
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, files, schema, required=())


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A-09/A-10: label catalogue from a JSON array file; empty name/description dropped,
    a duplicate name keeps its last entry, a missing file gives an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CATALOGUE)
    rows = (spark.read.option("multiLine", True).schema(CATALOGUE).json(path)
            .withColumn("_pos", F.monotonically_increasing_id())
            .filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("description", F.lit("")) != "")))
    return rows.groupBy("name").agg(
        F.max_by(F.struct("description", "category"), "_pos").alias("v")).select("name", "v.*")


def documents_as_records(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """A-11: driver documents as ``DetectedRecord`` rows (labels from our detector)."""
    from ..operators.detect import detected_records
    return detected_records(documents, candidates)

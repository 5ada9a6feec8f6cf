"""Sources, sinks and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Allowed enum values of a task.
TASK_TYPES = ["binary_classification", "multiclass_classification", "regression"]
METRICS = ["roc_auc", "accuracy", "f1", "log_loss", "rmse", "mae", "r2"]
ACTION_TYPES = ["PLAN", "FEATURE_ENGINEERING", "MODEL", "CODE", "CODE_FIX", "FINAL_SUBMIT"]

CHECKLIST_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("weight", T.DoubleType()),
    T.StructField("required", T.BooleanType()),
])

TASK_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("dataset_path", T.StringType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("plan_checklist", T.ArrayType(CHECKLIST_ITEM)),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("time_budget_seconds", T.DoubleType()),
    T.StructField("max_steps", T.IntegerType()),
    T.StructField("oracle_score", T.DoubleType()),
    T.StructField("baseline_score", T.DoubleType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

STEP_SCHEMA = T.StructType([
    T.StructField("episode_id", T.LongType()),
    T.StructField("step_idx", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("action_text", T.StringType()),
    T.StructField("code_body", T.StringType()),
    T.StructField("execution_success", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("metric_value", T.DoubleType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 fmt: str | None = None) -> DataFrame:
    """A dataset from CSV (with header) or parquet. An explicit schema is
    preferred; without one CSV types are inferred as the reference does."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        r = spark.read.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(path)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def select_features(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """The configured feature list, or every column but the target; the
    target is kept last as the label. Column pruning reaches the scan."""
    feats = list(features) if features else [c for c in df.columns if c != target]
    return df.select(*[F.col(c) for c in feats if c != target], F.col(target))


def _task_valid(col_map) -> F.Column:
    return (col_map["task_id"].isNotNull() & col_map["dataset_path"].isNotNull()
            & col_map["target_column"].isNotNull() & col_map["description"].isNotNull()
            & col_map["task_type"].isin(*TASK_TYPES) & col_map["metric"].isin(*METRICS))


def read_tasks_files(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """S3 over a folder written by :func:`write_tasks` (JSON lines files) or
    holding one task per ``*.json`` file."""
    return read_tasks(spark, directory, pattern="*", multi_line=False)


def read_tasks(spark: SparkSession, directory: str, pattern: str = "*.json",
               multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3: every ``*.json`` task file of a folder. Returns (good, rejected);
    malformed files (bad JSON, unknown enum, wrong shape, missing or unknown
    task or checklist fields, an array of tasks) are rejected with their file
    name, one row a file, as the reference skips them."""
    raw = (spark.read.option("wholetext", multi_line).option("pathGlobFilter", pattern).text(directory)
           .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("_text"))
           .where(F.trim("_text") != "" if not multi_line else F.lit(True)))
    schema = T.StructType(TASK_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    one = F.trim("_text").startswith("{")
    raw = raw.withColumn("_task", F.when(one, F.from_json("_text", schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})))
    known = F.array(*[F.lit(c) for c in TASK_SCHEMA.names])
    item_known = F.array(*[F.lit(c) for c in CHECKLIST_ITEM.names])
    fields = F.json_object_keys("_text")
    items = F.from_json(F.get_json_object("_text", "$.plan_checklist"), "array<string>")
    strange = F.size(F.array_except(F.when(one, fields), known)) > 0
    strange_item = F.exists(items, lambda i: F.coalesce(F.size(F.array_except(F.json_object_keys(i), item_known)) > 0,
                                                        F.lit(True)))
    raw = raw.select("file_name", "_text", "_task.*",
                     (F.coalesce(strange, F.lit(False)) | F.coalesce(strange_item, F.lit(False))).alias("_strange"))
    cols = {c: F.col(c) for c in TASK_SCHEMA.names}
    ok = F.coalesce(F.col("_corrupt_record").isNull() & ~F.col("_strange") & _task_valid(cols), F.lit(False))
    good = (raw.where(ok)
            .withColumn("time_budget_seconds", F.coalesce("time_budget_seconds", F.lit(300.0)))
            .withColumn("max_steps", F.coalesce("max_steps", F.lit(15)))
            .withColumn("plan_checklist", F.coalesce("plan_checklist", F.array().cast(T.ArrayType(CHECKLIST_ITEM))))
            .withColumn("plan_checklist", F.transform(
                "plan_checklist", lambda i: i.withField("weight", F.coalesce(i["weight"], F.lit(1.0)))
                .withField("required", F.coalesce(i["required"], F.lit(False)))
                .withField("keywords", F.coalesce(i["keywords"], F.array().cast("array<string>")))))
            .drop("_corrupt_record", "_text", "_strange"))
    rejected = raw.where(~ok).select("file_name", F.col("_text").alias("_corrupt_record"))
    return good, rejected


def write_tasks(df: DataFrame, directory: str, mode: str = "overwrite") -> None:
    """Inverse of S3, all 13 fields (nulls kept as JSON nulls)."""
    (df.select(*TASK_SCHEMA.names).write.mode(mode)
     .option("ignoreNullFields", False).json(directory))


def upsert_tasks(tasks: DataFrame, order_col: str = "file_name") -> DataFrame:
    """The last registration of a task_id wins (files load in name order)."""
    w = Window.partitionBy("task_id").orderBy(F.col(order_col).desc())
    return tasks.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lookup_task(tasks: DataFrame, keys: DataFrame) -> DataFrame:
    """S5 lookup: join requested ids to tasks; unknown ids come back with
    ``found = false`` (the reference raises)."""
    t = tasks.withColumn("found", F.lit(True))
    return keys.join(t, "task_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def explode_checklist(tasks: DataFrame) -> DataFrame:
    """One row per (task, checklist item, keyword). Items without keywords
    and tasks without a checklist keep one row with null fields."""
    items = tasks.select("task_id", F.posexplode_outer("plan_checklist").alias("item_idx", "item"))
    return items.select(
        "task_id", "item_idx",
        F.col("item.id").alias("item_id"),
        F.col("item.weight").alias("weight"),
        F.col("item.required").alias("required"),
        F.explode_outer("item.keywords").alias("keyword"))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def type_label(dt: T.DataType) -> str:
    return dt.simpleString()


def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, count of columns per type, total nulls (NaN counts as
    missing), all column names. One aggregate pass over the table."""
    nulls = [F.sum(_missing(df, c).cast("long")) for c in df.columns]
    total_nulls = F.lit(0).cast("long")
    for n in nulls:
        total_nulls = total_nulls + F.coalesce(n, F.lit(0).cast("long"))
    types: dict[str, int] = {}
    for f in df.schema.fields:
        types[type_label(f.dataType)] = types.get(type_label(f.dataType), 0) + 1
    by_type = ", ".join(f"{k}: {v}" for k, v in sorted(types.items()))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.lit(by_type).alias("dtypes"),
        total_nulls.alias("total_nulls"),
        F.lit(", ".join(df.columns)).alias("columns"),
    )


def _missing(df: DataFrame, c: str) -> F.Column:
    dt = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def append_steps(df: DataFrame, path: str, partition_col: str = "dt") -> None:
    """Append step records to the episode log, partitioned by day."""
    out = df if partition_col in df.columns else df.withColumn(partition_col, F.to_date("ts"))
    out.write.mode("append").partitionBy(partition_col).parquet(path)

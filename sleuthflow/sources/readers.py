"""Sources: transfer logs, labelled datasets, populations and nested case requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sleuthflow import catalog
from sleuthflow.functions.columns import require_columns, strip
from sleuthflow.operators.contracts import ops_reason
from sleuthflow.operators.entity import operational_to_features
from sleuthflow.sources import schemas

#: Different keys that JSON files may have if the caller does not name the columns.
MOST_COLUMNS = 4096


def spread_if_narrow(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that leaves most of the cluster idle.

    One large file with a single row group (or gzip) gives one task for everything up to the next shuffle.
    An input whose splits fill a quarter of the cores is returned as it is, since a shuffle of it would cost
    more. With the key of the next join as `keys`, that join uses the same partitioning.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if 4 * df.rdd.getNumPartitions() < cores else df


def _format_of(path: str) -> str:
    for name in ("csv", "json", "parquet"):
        if path.rstrip("/").lower().endswith("." + name):
            return name
    raise ValueError(f"Unsupported file format: {path}. Expected .csv, .json or .parquet")


def _columns(spark: SparkSession, path: str, multiline: bool) -> list[str]:
    """Column names as the file states them: the CSV header, or the keys of all JSON lines.

    A JSON key may first appear in any line, so all lines are read; only distinct names reach the driver, and files
    with data in their keys are refused.
    Loaders skip this pass if the caller names the columns.
    """
    if _format_of(path) == "csv":
        return spark.read.csv(path, header=True).columns
    if _format_of(path) == "json":
        if multiline:
            return spark.read.json(path, multiLine=True).columns
        keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("name")).distinct()
        names = sorted(row["name"] for row in keys.limit(MOST_COLUMNS + 1).collect())
        if len(names) > MOST_COLUMNS:
            raise ValueError(f"{path} has more than {MOST_COLUMNS} different keys; name the columns to load.")
        return names
    return spark.read.parquet(path).columns


def _read(spark: SparkSession, path: str, schema: T.StructType, multiline: bool) -> DataFrame:
    kind = _format_of(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    if kind == "json":
        return spark.read.schema(schema).json(path, multiLine=multiline)
    return spark.read.parquet(path)


def _typed(
    spark: SparkSession, path: str, known: T.StructType, what: str, multiline: bool, columns: list[str] | None = None
) -> DataFrame:
    """Read with the declared types; columns the schema does not know pass through as text."""
    present = columns or _columns(spark, path, multiline)
    missing = sorted({f.name for f in known} - set(present))
    if missing:
        raise ValueError(f"Missing columns in {what}: {missing}")
    declared = {f.name: f for f in known}
    schema = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in present])
    return _read(spark, path, schema, multiline)


def load_transactions(
    spark: SparkSession, path: str, multiline: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """Transfer log from CSV, JSON or Parquet, chosen by suffix; NaN amounts become NULL.

    An amount or time that cannot be read stops the job that reads it, as it would sum to a wrong total;
    `check_transactions` gives such rows a reason instead. `columns` names the columns to read.

    JSON is read as one object per line so that files can be split; pass `multiline=True` for a file
    that is one JSON array.
    """
    checked = check_transactions(spark, path, multiline, columns)
    stopped = F.when(F.col("reason").isNull(), F.col("amount")).otherwise(F.raise_error(F.col("reason")))
    return checked.withColumn("amount", stopped).drop("reason")


def check_transactions(
    spark: SparkSession, path: str, multiline: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """The transfer log with a `reason` for every row whose amount or time cannot be read, NULL for the others."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schemas.TRANSACTIONS])
    raw = _typed(spark, path, as_text, "transaction log", multiline, columns)
    kind = raw.schema["amount"].dataType
    amount, bad = F.col("amount"), F.lit(False)
    if isinstance(kind, T.StringType):
        amount = strip("amount").try_cast("double")
        bad = amount.isNull() & (strip("amount") != "")
    if isinstance(kind, (T.StringType, T.DoubleType, T.FloatType)):
        amount = F.when(~F.isnan(amount), amount)
    when, late = F.col("timestamp"), F.lit(False)
    if isinstance(raw.schema["timestamp"].dataType, T.StringType):
        when = strip("timestamp").try_cast("timestamp")
        late = when.isNull() & (strip("timestamp") != "")
    reason = F.when(bad, F.concat(F.lit("Unreadable amount: "), F.col("amount"))).when(
        late, F.concat(F.lit("Unreadable timestamp: "), F.col("timestamp"))
    )
    checked = raw.withColumn("reason", reason)
    return checked.withColumns({"amount": amount, "timestamp": when.cast("timestamp")})


def load_dataset(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Labelled training set: model features as they are, or operational facts converted to features."""
    known = schemas.doubles(catalog.FEATURES + catalog.OPERATIONAL) + [T.StructField("label", T.IntegerType())]
    known.append(T.StructField("is_borderline", T.BooleanType()))
    present = _columns(spark, path, multiline)
    schema = T.StructType([f for f in known if f.name in present])
    return to_labeled_features(_typed(spark, path, schema, "dataset", multiline))


def to_labeled_features(df: DataFrame) -> DataFrame:
    """Route by columns: 9 features + label pass through; 12 facts + label are converted.

    Facts that break a bound raise in the job that reads them: a training set is all or nothing.
    """
    names = set(df.columns)
    if "label" in names and names.issuperset(catalog.FEATURES):
        return df
    if "label" in names and names.issuperset(catalog.OPERATIONAL):
        reason = ops_reason()
        checked = df.withColumn("label", F.when(reason.isNull(), F.col("label")).otherwise(F.raise_error(reason)))
        keep = ["label"] + (["id"] if "id" in names else [])
        return operational_to_features(checked, keep=keep).withColumn("label", F.col("label").cast("int"))
    raise ValueError("Dataset must contain the 9 model features or the 12 operational facts, and a 'label' column.")


def load_population(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return _typed(spark, path, schemas.POPULATION, "population dataset", multiline)


def load_ledger(
    spark: SparkSession, path: str, multiline: bool = False, amount_type: str = "double"
) -> DataFrame:
    """Company ledger. `amount_type` may name an exact decimal; amounts are never rounded to one unasked."""
    needed = ("company_id", "timestamp", "amount", "direction", "counterparty_type", "counterparty_name")
    present = _columns(spark, path, multiline)
    schema = T.StructType([f for f in schemas.LEDGER if f.name in needed or f.name in present])
    schema = T.StructType([f if f.name != "amount" else T.StructField("amount", T.DataType.fromDDL(amount_type)) for f in schema])
    return _typed(spark, path, schema, "company ledger", multiline)


def load_case_requests(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Nested requests, one object each, or batches of them as {"cases": [...]}."""
    one = schemas.CASE_REQUEST
    schema = T.StructType([*one.fields, T.StructField("cases", T.ArrayType(one))])
    single = F.array(F.struct(*[F.col(f.name) for f in one]))
    read = spark.read.schema(schema).json(path, multiLine=multiline)
    return read.select(F.inline(F.coalesce("cases", single)))


def explode_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested requests -> (events with their input position, case attributes). Blank ids get a fixed name.

    Every request has its own `request_id` in both tables, so that requests with equal or blank case ids stay
    apart. It is made of the request's place in the input; `requests` must give the same rows in the same order
    each time it is read, as files do.
    """
    require_columns(requests, ["case_id", "events"], "case requests")
    trimmed = strip("case_id")
    case_id = F.when(trimmed != "", trimmed).otherwise(F.lit("unknown-case"))
    requests = requests.withColumn("request_id", F.monotonically_increasing_id().cast("string"))
    events = (
        requests.select("request_id", case_id.alias("request_case_id"), F.posexplode("events").alias("pos", "event"))
        .select("request_id", "request_case_id", "pos", "event.*")
        .withColumnRenamed("case_id", "event_case_id")
        .withColumnRenamed("request_case_id", "case_id")
    )
    attributes = ["window_hours", "tabular_features"]
    present = [c for c in attributes if c in requests.columns]
    cases = requests.select("request_id", case_id.alias("case_id"), *present)
    if "window_hours" in present:
        cases = cases.withColumn("window_hours", F.coalesce("window_hours", F.lit(24)))
    return events, cases

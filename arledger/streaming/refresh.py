"""Continuous refresh: new snapshot files in, trend tables of the touched snapshots out.

Files arrive as ``root/<sheet>/<file>``; a changed sheet comes as a file with a new name. Two
sources feed a store:

* ``stream_snapshots`` streams the rows of files that share one schema;
* ``stream_files`` streams file names, and each batch reads its files by their own headers.

Each micro-batch lands its raw rows. Landed rows are then merged (``merge_landed``): a second
stream, over the landed files, cleans every row once and keeps the hashes of all cleaned rows of a
sheet as its state, so that only rows that are new to their sheet pass. Their measures are added up
and written as one increment per batch; the trend rows of the touched snapshots are sums of
increments. A batch costs what its own rows cost, however much has landed before.

All writes replace whole partitions and landed rows are partitioned by batch, so a batch that
is run again after a failure changes nothing: rows landed again are not new.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from arledger.functions.headers import distinct_names, standard_name
from arledger.operators.cleaning import clean_claims
from arledger.operators.columns import LINEAGE, resolve
from arledger.operators.measures import MEASURES, claim_measures, condense
from arledger.operators.snapshots import date_grouped, parse_snapshot_date, sheet_list
from arledger.plans.trend import aging_trend, snapshot_summary, trend_cube
from arledger.session import lean_writes
from arledger.sources.landing import CODEC, PARTITIONS
from arledger.sources.snapshots import place_files, read_files

_ROW_POS = "decimal(38,0)"
_TRACE = ("sheet_name", "uri", "start", "index")
_NOTE_SCHEMA = "columns array<string>, sheets array<string>"

#: Where the hashes of a store's rows are kept: on local disk, with changes in the checkpoint.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Increments after which they are added up, so that a batch reads a bounded number of them.
_FOLD = 32

SUMMARY_SCHEMA = (
    "snapshot_label string, total_claims long, open_claims long, outstanding_balance double, "
    "claims_worked long, dollars_recovered double, refreshed_at timestamp, "
    "snapshot_date timestamp, sheet_name string"
)
AGING_SCHEMA = (
    "aging_bucket string, claim_count long, done_count long, outstanding_balance double, "
    "recovered_amount double, total_claimed double, percentage_of_total_balance double, "
    "snapshot_label string, refreshed_at timestamp, snapshot_date timestamp, sheet_name string"
)


def stream_snapshots(
    spark: SparkSession,
    root: str,
    columns: Sequence[str],
    fmt: str = "csv",
    max_files: int = 1000,
) -> DataFrame:
    """Stream of new snapshot rows: text columns under standard names, plus where each row
    stands. ``columns`` are the headers of the files. ``max_files`` bounds a micro-batch."""
    _check_bound(max_files)
    reader = (
        spark.readStream.format(fmt)
        .schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
    )
    if fmt == "csv":
        reader = reader.options(header="true", enforceSchema="false", escape='"')
    names = distinct_names([standard_name(c) or f"column_{i}" for i, c in enumerate(columns)])
    uri = F.col("_metadata.file_path")
    folder = F.substring_index(F.substring_index(uri, "/", -2), "/", 1)
    escaped = F.replace(folder, F.lit("+"), F.lit("%2B"))
    # Decoded twice: once for the URI form, once for the escapes in the name itself.
    decoded = F.url_decode(F.replace(F.url_decode(escaped), F.lit("+"), F.lit("%2B")))
    sheet = F.when(folder.contains("%"), decoded).otherwise(folder)
    if fmt == "parquet":
        place = [F.lit(0).cast("bigint").alias("start"), F.col("_metadata.row_index").alias("index")]
    else:
        place = [F.col("_metadata.file_block_start").alias("start")]
    return reader.load(root).select(
        sheet.alias("sheet_name"),
        uri.alias("uri"),
        *place,
        *(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)),
    )


def stream_files(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Stream of new files: (uri, path). File contents are not read here."""
    _check_bound(max_files)
    listed = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    return listed.select(F.col("_metadata.file_path").alias("uri"), "path")


def _check_bound(max_files: int) -> None:
    # A row's position holds its file's number within the batch.
    if not 0 < max_files < 100_000:
        raise ValueError("max_files must be between 1 and 99999")


def _landed_schema(columns: Sequence[str]) -> T.StructType:
    text = [T.StructField(c, T.StringType()) for c in columns]
    return T.StructType(
        [
            T.StructField("row_pos", T.DecimalType(38, 0)),
            *text,
            T.StructField("snapshot_date", T.TimestampType()),
            T.StructField("sheet_name", T.StringType()),
            T.StructField("batch_id", T.LongType()),
        ]
    )


def _replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    with lean_writes(df.sparkSession):
        (
            df.select("*").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(path, compression=CODEC)
        )


def read_raw(spark: SparkSession, store: str, columns: Sequence[str]) -> DataFrame:
    """All landed raw rows of a store, sheets in date order."""
    rows = spark.read.schema(_landed_schema(columns)).parquet(f"{store}/raw")
    return rows.withColumn("sheet_pos", F.unix_date(F.to_date("snapshot_date"))).drop("batch_id")


def _land_batch(batch: DataFrame, batch_id: int, store: str) -> list[str]:
    """Append a batch of rows to the raw store; returns the sheets it touched. File names, at
    most ``max_files`` of them, come to the driver; rows do not."""
    files = sorted(
        (r["uri"], r["sheet_name"]) for r in batch.select("uri", "sheet_name").distinct().collect()
    )
    if not files:
        return []
    if "index" not in batch.columns:
        # Text rows are numbered here, where the batch is a plain frame over file splits.
        in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        batch = batch.withColumn("index", in_task)
    spark = batch.sparkSession
    places = spark.createDataFrame(
        [(uri, sheet, i) for i, (uri, sheet) in enumerate(files)], "uri string, sheet_name string, file_pos long"
    ).withColumn("snapshot_date", parse_snapshot_date(F.col("sheet_name")))
    position = _shifted("file_pos", 26) + _shifted("start", 11) + _shifted("index", 0)
    # A row per file: rows stay in their tasks, and names are read as dates once per file.
    rows = batch.drop("snapshot_date").join(F.broadcast(places), ["uri", "sheet_name"]).select(
        position.cast(_ROW_POS).alias("row_pos"),
        *(c for c in batch.columns if c not in (*_TRACE, "snapshot_date")),
        "sheet_name",
        "snapshot_date",
    )
    sheets = sorted({sheet for _, sheet in files})
    _land_rows(rows, sheets, batch_id, store)
    return sheets


def _land_files(
    batch: DataFrame, batch_id: int, store: str, root: str, fmt: str, on_error: str
) -> list[str]:
    """Append the rows of a batch of files to the raw store, each file by its own header;
    returns the sheets it touched."""
    spark = batch.sparkSession
    names = [(r["uri"], r["path"]) for r in batch.collect()]
    if not names:
        return []
    files = place_files(spark, names, root)
    rows = read_files(spark, files, fmt, on_error=on_error)
    if rows is None:
        return []
    sheets = sorted(r["sheet_name"] for r in files.select("sheet_name").distinct().collect())
    _land_rows(rows.drop("sheet_pos"), sheets, batch_id, store)
    return sheets


def _shifted(name: str, digits: int):
    return F.col(name).cast(_ROW_POS) * F.lit(Decimal(10) ** digits)


def _land_rows(rows: DataFrame, sheets: Sequence[str], batch_id: int, store: str) -> None:
    """Write rows with their position in the batch and their sheet's date, and a note of the
    batch's columns. Rows stay in the tasks that read them: a task reads few files, and so few
    sheets, and writes a file for each of them."""
    spark = rows.sparkSession
    position = F.lit(batch_id).cast(_ROW_POS) * F.lit(Decimal(10) ** 31) + F.col("row_pos")
    columns = [c for c in rows.columns if c not in LINEAGE]
    number = F.lit(batch_id).cast("bigint").alias("batch_id")
    landed = rows.select(
        position.cast(_ROW_POS).alias("row_pos"),
        *columns,
        "snapshot_date",
        "sheet_name",
        number,
    )
    _replace_partitions(landed, f"{store}/raw", (*PARTITIONS, "batch_id"))
    note = spark.createDataFrame([(columns, list(sheets))], _NOTE_SCHEMA).select("*", number)
    _replace_partitions(note, f"{store}/batches", ["batch_id"])


def landed_columns(spark: SparkSession, store: str) -> list[str]:
    """Columns of all landed batches, in the order of their first appearance."""
    notes = spark.read.schema(f"{_NOTE_SCHEMA}, batch_id bigint").parquet(f"{store}/batches")
    return list(dict.fromkeys(c for r in notes.orderBy("batch_id").collect() for c in r["columns"]))


def refresh_snapshots(
    spark: SparkSession,
    store: str,
    columns: Sequence[str],
    touched: Sequence[str],
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Compute the trend rows of the touched sheets again. ``keep`` may filter the cleaned
    rows; a sheet it empties keeps a summary row of zeros."""
    raw = read_raw(spark, store, columns).filter(F.col("sheet_name").isin(*touched))
    claims = clean_claims(raw, duplicates="keep")
    if keep is not None:
        claims = keep(claims)
    _write_trend(trend_cube(claims), sheet_list(raw), store)


def _write_trend(cube: DataFrame, sheets: DataFrame, store: str) -> None:
    """Summary and aging of the given sheets, which replace earlier ones."""
    spark = cube.sparkSession
    # A few rows per sheet, used by both tables; rebuilt from files if an executor is lost.
    cube = cube.persist()
    try:
        # One time for both tables of a refresh.
        now = spark.range(1).select(F.current_timestamp()).first()[0]
        summary = snapshot_summary(cube, sheets).withColumn("refreshed_at", F.lit(now))
        aging = aging_trend(cube).withColumn("refreshed_at", F.lit(now))
        # A sheet that is left without rows still writes its partition, which replaces an
        # earlier one; its mark has no values and is not read.
        marks = (
            sheets.select("snapshot_date", "sheet_name")
            .join(aging.select("sheet_name").distinct(), "sheet_name", "left_anti")
            .withColumn("refreshed_at", F.lit(now))
        )
        _replace_partitions(summary, f"{store}/summary", PARTITIONS)
        _replace_partitions(
            aging.unionByName(marks, allowMissingColumns=True), f"{store}/aging", PARTITIONS
        )
    finally:
        cube.unpersist()


def _row_key(claims: DataFrame):
    """128-bit hash of a cleaned row. Null cells do not count, so a column that a file lacks is a
    column of nulls."""
    cells = []
    for field in sorted(claims.schema.fields, key=lambda f: f.name):
        if field.name in LINEAGE:
            continue
        cell = F.col(field.name)
        # Minus zero equals zero.
        cells.append((cell + 0.0 if isinstance(field.dataType, T.DoubleType) else cell).alias(field.name))
    return F.unhex(F.md5(F.to_json(F.struct(*cells))))


def _keyed_measures(claims: DataFrame) -> DataFrame:
    """Measures of each row under its sheet and key. Equal rows have equal measures, so that no other
    column has to go to the state that knows the keys."""
    return claim_measures(claims.withColumn("_key", _row_key(claims)), ["_key"])


def _increments(spark: SparkSession, store: str) -> DataFrame:
    """Measures of all merged rows: the newest fold and the increments after it."""
    parts = spark.read.schema(_CUBE_SCHEMA).parquet(f"{store}/cube")
    folds = parts.where("kind = 'fold'").agg(F.max("merge_id")).first()[0]
    newer = (F.col("kind") == "increment") & (F.col("merge_id") > (-1 if folds is None else folds))
    return parts.where(newer if folds is None else newer | ((F.col("kind") == "fold") & (F.col("merge_id") == folds)))


_CUBE_SCHEMA = (
    "sheet_name string, aging_bucket string, worked_by string, n_claims bigint, n_open bigint, "
    "n_done bigint, n_worked bigint, sum_outstanding double, sum_recovered double, "
    "kind string, merge_id bigint"
)


def merge_landed(
    spark: SparkSession,
    store: str,
    touched: Sequence[str] = (),
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Merge what has landed since the last call into the trend tables; returns the finished
    query, whose progress tells the rows it read. ``touched`` sheets get rows in the tables even
    if no row of them passes ``keep``, a filter on rows, which belongs to the store."""
    columns = landed_columns(spark, store)
    raw = spark.readStream.schema(_landed_schema(columns)).parquet(f"{store}/raw")
    claims = clean_claims(raw, duplicates="keep")
    if keep is not None:
        claims = keep(claims)
    new = _keyed_measures(claims).dropDuplicates(["sheet_name", "_key"])
    merged: set[str] = set(touched)

    def add(batch: DataFrame, merge_id: int) -> None:
        if "n_claims" not in claims.columns:
            for role in ("balance", "worked_by", "aging_bucket"):
                resolve(claims, role, required=True)
        sums = condense(batch.drop("snapshot_date", "batch_id", "_key"))
        kept = [c for c in (*_CUBE_KEYS, *MEASURES) if c in sums.columns]
        marks = {"kind": F.lit("increment"), "merge_id": F.lit(merge_id).cast("bigint")}
        _replace_partitions(sums.select(*kept).withColumns(marks), f"{store}/cube", ("kind", "merge_id"))
        if merge_id % _FOLD == _FOLD - 1:
            parts = _increments(spark, store).groupBy(*_CUBE_KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))
            marks["kind"] = F.lit("fold")
            _replace_partitions(parts.withColumns(marks), f"{store}/cube", ("kind", "merge_id"))
        here = spark.read.schema(_CUBE_SCHEMA).parquet(f"{store}/cube").where(
            (F.col("kind") == "increment") & (F.col("merge_id") == merge_id)
        )
        merged.update(r["sheet_name"] for r in here.select("sheet_name").distinct().collect())

    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        query = (
            new.writeStream.foreachBatch(add)
            .option("checkpointLocation", f"{store}/_merge")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    if merged:
        _write_tables(spark, store, sorted(merged))
    return query


_CUBE_KEYS = ("sheet_name", "aging_bucket", "worked_by")


def _write_tables(spark: SparkSession, store: str, names: Sequence[str]) -> None:
    """Trend rows of some sheets from the increments."""
    dated = parse_snapshot_date(F.col("sheet_name"))
    sheets = spark.createDataFrame([(n,) for n in names], "sheet_name string")
    sheets = _placed(sheets.withColumn("snapshot_date", dated).where("snapshot_date is not null"))
    cube = _increments(spark, store).where(F.col("sheet_name").isin(*names)).drop("kind", "merge_id")
    cube = _placed(date_grouped(cube, "n_claims"))
    _write_trend(cube, sheets, store)


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("sheet_pos", F.unix_date(F.to_date("snapshot_date")))


def refresh_landed(
    spark: SparkSession,
    store: str,
    columns: Sequence[str],
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Compute the trend rows of all landed sheets again, each once, for another ``keep`` than
    the one they were merged with. Only sheet names, which are partition values, come to the driver."""
    names = read_raw(spark, store, columns).select("sheet_name").distinct().collect()
    refresh_snapshots(spark, store, columns, sorted(r["sheet_name"] for r in names), keep)


def refresh_metrics(
    stream: DataFrame,
    store: str,
    *,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    every: str | None = "30 minutes",
    checkpoint: str | None = None,
    land_only: bool = False,
) -> StreamingQuery:
    """Start the refresh of ``store`` (a folder all executors reach) from a stream of
    snapshot rows. ``every=None`` takes in what is there and stops. With ``land_only`` rows are
    merged by a later call of ``merge_landed``.

    The checkpoint belongs to the store: with a new one, batches would be numbered from
    zero again and replace earlier ones.
    """

    def land(batch: DataFrame, batch_id: int) -> list[str]:
        return _land_batch(batch, batch_id, store)

    return _refresh(stream, land, store, keep, every, checkpoint, land_only)


def refresh_files(
    spark: SparkSession,
    root: str,
    store: str,
    fmt: str = "csv",
    *,
    max_files: int = 1000,
    on_error: str = "raise",
    keep: Callable[[DataFrame], DataFrame] | None = None,
    every: str | None = "30 minutes",
    checkpoint: str | None = None,
    land_only: bool = False,
) -> StreamingQuery:
    """``refresh_metrics`` of the files below ``root``, whose headers and types may differ from
    file to file. ``on_error`` is that of ``read_snapshots``."""

    def land(batch: DataFrame, batch_id: int) -> list[str]:
        return _land_files(batch, batch_id, store, root, fmt, on_error)

    stream = stream_files(spark, root, max_files)
    return _refresh(stream, land, store, keep, every, checkpoint, land_only)


def _refresh(
    stream: DataFrame,
    land: Callable[[DataFrame, int], list[str]],
    store: str,
    keep: Callable[[DataFrame], DataFrame] | None,
    every: str | None,
    checkpoint: str | None,
    land_only: bool,
) -> StreamingQuery:
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        touched = land(batch, batch_id)
        if touched and not land_only:
            merge_landed(batch.sparkSession, store, touched, keep)

    writer = stream.writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", checkpoint or f"{store}/_checkpoint"
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def read_summary(spark: SparkSession, store: str) -> DataFrame:
    """Snapshot summary as last refreshed, oldest first."""
    table = spark.read.schema(SUMMARY_SCHEMA).parquet(f"{store}/summary")
    return table.orderBy("snapshot_date", "sheet_name")


def read_aging(spark: SparkSession, store: str) -> DataFrame:
    """Aging per snapshot as last refreshed."""
    table = spark.read.schema(AGING_SCHEMA).parquet(f"{store}/aging")
    return table.filter(F.col("claim_count").isNotNull())


def last_refresh(spark: SparkSession, store: str) -> DataFrame:
    """One row: when the summary was last refreshed."""
    return read_summary(spark, store).agg(F.max("refreshed_at").alias("last_refresh"))

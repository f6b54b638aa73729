"""CSV layer and Parquet store of the seven tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginflow.functions.totals import contract_totals
from marginflow.model import SCHEMAS, TABLE_NAMES, TOTALS_TABLE, PricingTables, conform

# Low-cardinality columns that most predicates name, and the key the drill-downs filter on.
_PARTITIONS = {
    "contracts": ("tenant_id",),
    TOTALS_TABLE: ("tenant_id",),
    "transactions": ("tenant_id", "year"),
}
_SORTED_BY = {
    "contracts": "idn_id",
    "transactions": "idn_id",
    TOTALS_TABLE: "contract_id",
    "rebate_programs": "contract_id",
}
#: Tables with few rows for each contract, which are stored by it.
_BUCKETED = ("contracts", "rebate_programs", TOTALS_TABLE)


def write_csv(tables: PricingTables, directory: str, names: tuple[str, ...] = TABLE_NAMES) -> None:
    """One folder of CSV files with header per table."""
    for name in names:
        getattr(tables, name).write.mode("overwrite").option("header", True).csv(
            f"{directory}/{name}"
        )


def parse_dates(df: DataFrame, table: str) -> DataFrame:
    """Turn the text dates of a raw table into dates; unreadable text raises."""
    return conform(df, table)


def read_csv(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """Typed table from its CSV folder; a malformed row fails the job."""
    as_text = SCHEMAS[table].replace(" date,", " string,")
    raw = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(f"{directory}/{table}")
    )
    return parse_dates(raw, table)


_RAW_LINE = "_raw_line"


@dataclass(frozen=True)
class CheckedCsv:
    """Rows of a CSV table that are readable, and ``rejects``: ``table_name, reason, record`` of the others."""

    rows: DataFrame
    rejects: DataFrame


def read_csv_checked(spark: SparkSession, directory: str, table: str) -> CheckedCsv:
    """As ``read_csv``, but a bad row costs that row only and says why.

    A row is rejected if its number of fields is wrong (``malformed row``), or if a value can't be read as
    the type of its column (``unreadable <column>``, the first such column).  Every row of the files is on
    one side.
    """
    fields = [field.strip().rsplit(" ", 1) for field in SCHEMAS[table].split(",")]
    raw = (
        spark.read.schema(", ".join(f"{name} string" for name, _ in fields) + f", {_RAW_LINE} string")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)  # else a field too many is only seen by who reads it
        .option("columnNameOfCorruptRecord", _RAW_LINE)
        .csv(f"{directory}/{table}")
    )
    reason = F.when(F.col(_RAW_LINE).isNotNull(), F.lit("malformed row"))
    for name, kind in fields:
        unread = F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()
        reason = reason.when(unread, F.lit(f"unreadable {name}"))
    judged = raw.withColumn("reason", reason)
    as_found = F.to_csv(F.struct(*[name for name, _ in fields]))
    return CheckedCsv(
        conform(judged.filter("reason IS NULL"), table),
        judged.filter("reason IS NOT NULL").select(
            F.lit(table).alias("table_name"), "reason", F.coalesce(_RAW_LINE, as_found).alias("record")
        ),
    )


def reject_report(checked: list[CheckedCsv]) -> DataFrame:
    """``table_name, reason, rejected``: rejected rows of several tables, counted by reason."""
    rejects = reduce(DataFrame.unionByName, [c.rejects for c in checked])
    return rejects.groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("rejected"))


_MANIFEST = "version bigint, entries array<struct<table: string, folder: string, buckets: int>>"


@dataclass(frozen=True)
class Entry:
    """Where a version keeps a table; ``buckets`` is 0 for a table that isn't stored by contract."""

    table: str
    folder: str
    buckets: int


def current_version(spark: SparkSession, path: str) -> tuple[int, dict[str, Entry]]:
    """Number and tables of the newest complete version; (0, {}) before the first.

    A manifest is one small file that its job moves into place when it is complete.
    """
    if not _exists(spark, f"{path}/manifests"):
        return 0, {}
    newest = spark.read.schema(_MANIFEST).json(f"{path}/manifests/*").orderBy(F.desc("version")).first()
    if newest is None:
        return 0, {}
    return newest.version, {e.table: Entry(e.table, e.folder, e.buckets) for e in newest.entries}


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_store(
    tables: PricingTables, path: str, names: tuple[str, ...] = TABLE_NAMES, buckets: int | None = None
) -> int:
    """Full rebuild of ``names`` as a new version of the store; returns its number.

    Every table goes to a folder of its own, and the manifest that names the folders comes last: a
    reader sees the old version or the new one, and a rebuild that fails leaves the old one as it
    was.  Tables not named are taken over.  Two rebuilds at a time can't make the same
    version: the later one fails.

    Tenant tables are partitioned by tenant, lines also by year.  The rebalance hint evens out file
    sizes at run time and splits a tenant that holds most of the rows over as many tasks as
    its size needs.  Rows are sorted by customer within each file, so that a drill-down skips pages by
    their statistics.  Contracts, their rebates and the totals of their lines are stored in ``buckets``
    of the contract (by default as many as the session's shuffle partitions) and meet without an
    exchange.  Lines aren't: one contract may hold a third of them, and a bucket can't be split.
    """
    folder = f"{path}/data/{uuid.uuid4().hex}"
    spark = tables.gpos.sparkSession
    version, entries = current_version(spark, path)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in names:
        entry = Entry(name, f"{folder}/{name}", buckets if name in _BUCKETED else 0)
        _write(getattr(tables, name), entry)
        entries[name] = entry
        if name == "transactions":
            entry = Entry(TOTALS_TABLE, f"{folder}/{TOTALS_TABLE}", buckets)
            _write(contract_totals(_read(spark, entries[name])), entry)
            entries[TOTALS_TABLE] = entry
    row = (version + 1, [(e.table, e.folder, e.buckets) for e in entries.values()])
    manifest = spark.createDataFrame([row], _MANIFEST).coalesce(1)
    manifest.write.mode("errorifexists").json(f"{path}/manifests/{version + 1:012d}")
    return version + 1


def _write(frame: DataFrame, entry: Entry) -> None:
    name, columns = entry.table, _PARTITIONS.get(entry.table, ())
    if entry.buckets:
        writer = frame.repartition(entry.buckets, "contract_id").write.option("path", entry.folder)
        writer = writer.bucketBy(entry.buckets, "contract_id").sortBy(_SORTED_BY[name])
        writer.format("parquet").partitionBy(*columns).saveAsTable(_registered(entry))
        return
    if columns:
        frame = frame.hint("rebalance", *columns).sortWithinPartitions(*columns, _SORTED_BY[name])
    frame.write.partitionBy(*columns).parquet(entry.folder)


def _registered(entry: Entry) -> str:
    """Name of a bucketed table in the session's catalogue, where Spark keeps what its buckets are."""
    return f"marginflow_{hashlib.sha256(entry.folder.encode()).hexdigest()[:24]}_{entry.table}"


def _read(spark: SparkSession, entry: Entry) -> DataFrame:
    name, columns = entry.table, _PARTITIONS.get(entry.table, ())
    if not entry.buckets:
        return conform(spark.read.schema(SCHEMAS[name]).parquet(entry.folder), name)
    table = _registered(entry)
    if not spark.catalog.tableExists(table):
        partitioned = f"PARTITIONED BY ({', '.join(columns)})" if columns else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({SCHEMAS[name]}) USING parquet {partitioned} "
            f"CLUSTERED BY (contract_id) SORTED BY ({_SORTED_BY[name]}) INTO {entry.buckets} BUCKETS "
            f"LOCATION '{entry.folder}'"
        )
        if columns:
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return conform(spark.table(table), name)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest ``keep`` versions, manifests first; returns the numbers of those dropped.

    Folders that a kept version names, and those of an unfinished rebuild, stay.
    """
    if not _exists(spark, f"{path}/manifests"):
        return []
    found = spark.read.schema(_MANIFEST).json(f"{path}/manifests/*").orderBy(F.desc("version")).collect()
    held = {e.folder for row in found[:keep] for e in row.entries}
    gone = {Entry(e.table, e.folder, e.buckets) for row in found[keep:] for e in row.entries if e.folder not in held}
    for row in found[keep:]:
        _delete(spark, f"{path}/manifests/{row.version:012d}")
    for entry in gone:
        if entry.buckets:
            spark.sql(f"DROP TABLE IF EXISTS {_registered(entry)}")
        _delete(spark, entry.folder)
    return [row.version for row in found[keep:]]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class StoredTables(PricingTables):
    """Tables of one version of a store, the newest when they are first read.

    File sizes guide the join strategy.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    @cached_property
    def _entries(self) -> dict[str, Entry]:
        entries = current_version(self.spark, self.path)[1]
        if not entries:
            raise FileNotFoundError(f"no complete version of a store in {self.path}")
        return entries

    def _table(self, name: str) -> DataFrame:
        return _read(self.spark, self._entries[name])

    @cached_property
    def gpos(self) -> DataFrame:
        return self._table("gpos")

    @cached_property
    def idns(self) -> DataFrame:
        return self._table("idns")

    @cached_property
    def facilities(self) -> DataFrame:
        return self._table("facilities")

    @cached_property
    def products(self) -> DataFrame:
        return self._table("products")

    @cached_property
    def contracts(self) -> DataFrame:
        return self._table("contracts")

    @cached_property
    def rebate_programs(self) -> DataFrame:
        return self._table("rebate_programs")

    @cached_property
    def transactions(self) -> DataFrame:
        return self._table("transactions")

    @cached_property
    def contract_totals(self) -> DataFrame:
        return self._table(TOTALS_TABLE)


def row_counts(tables: PricingTables, names: tuple[str, ...] = TABLE_NAMES) -> DataFrame:
    """Load report: rows per table."""
    counts = [
        getattr(tables, name).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name in names
    ]
    return reduce(DataFrame.unionByName, counts)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach.

    Taken under ``spark.checkpoint.dir``.  A machine-local folder is used only when
    Spark itself runs on this one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return f"{root.rstrip('/')}/marginflow-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="marginflow-")
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")

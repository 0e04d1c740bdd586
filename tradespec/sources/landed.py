"""Files landed by a download step: API payloads and data set folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradespec.sources.readers import QUOTING, read_inferred_csv


def read_payload_rows(
    spark: SparkSession,
    path: str,
    row_schema: T.StructType | str,
    multi_line: bool = False,
    unknown: str | None = None,
) -> DataFrame:
    """Rows of JSON payloads: those under ``data.list``, or ``data`` itself.

    Both shapes may be mixed in one folder. A payload without data gives no
    rows, and so does one that is not JSON or names a field twice. One payload
    per line by default, one per file with ``multi_line``; the rows of a payload
    are one task's, so a landing step should page its requests.

    A payload is parsed once, into a variant, of which only the paths of the
    known fields are looked up. Quoted numbers count, whole numbers may be written
    as ``5.0``, and what does not fit its type becomes null. ``unknown`` names a
    column of type ``map<string,variant>`` for the fields that the schema does
    not have; without it they are dropped.
    """
    row_type = (
        T.StructType.fromDDL(row_schema) if isinstance(row_schema, str) else row_schema
    )
    lines = spark.read.text(path, wholetext=multi_line)
    parsed = lines.select(F.try_parse_json("value").alias("parsed"))
    several = F.try_variant_get("parsed", "$", "array<variant>")
    payloads = parsed.select(
        F.explode(F.coalesce(several, F.array("parsed"))).alias("payload")
    )
    found = F.coalesce(
        F.try_variant_get("payload", "$.data.list", "array<variant>"),
        F.try_variant_get("payload", "$.data", "array<variant>"),
    )
    rows = payloads.select(F.explode(found).alias("row"))
    fields = [
        _typed(F.try_variant_get("row", f"$['{f.name}']", "string"), f.dataType).alias(f.name)
        for f in row_type
    ]
    if unknown is not None:
        known = F.array(*[F.lit(f.name) for f in row_type])
        every = F.try_variant_get("row", "$", "map<string,variant>")
        fields.append(
            F.map_filter(every, lambda name, _: ~F.array_contains(known, name)).alias(unknown)
        )
    return rows.select(*fields)


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        exact = text.try_cast("decimal(38,10)")
        whole = F.when(exact == F.floor(exact), exact).try_cast(kind)
        return F.coalesce(text.try_cast(kind), whole)
    return text.try_cast(kind)


def _files_of(spark: SparkSession, path: str) -> tuple:
    """The file system that a path belongs to, and the path as it knows it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def list_tables(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Names directly under ``folder`` that end in ``suffix``, files or folders.

    One listing of one level, however many part files the tables have.
    """
    files, root = _files_of(spark, folder)
    names = (status.getPath().getName() for status in files.listStatus(root))
    return sorted(name for name in names if name.endswith(suffix))


def read_dataset(
    spark: SparkSession,
    folder: str,
    target: str | None = None,
    overrides: dict[str, T.DataType] | None = None,
    reader: Callable[..., DataFrame] = read_inferred_csv,
    absent: str | T.StructType = "",
    failed: dict[str, str] | None = None,
) -> DataFrame | dict[str, DataFrame]:
    """CSV tables of a landed data set: the named one, or all of them by name.

    A named table that is not there is empty, with the columns ``absent``. Read all
    together, a table takes those overrides whose columns it has; one that cannot
    be read raises, or if ``failed`` is given is left out and noted there.
    """
    root = folder.rstrip("/")
    if target is not None:
        if not target.endswith(".csv"):
            raise ValueError(f"not a CSV table: {target}")
        files, path = _files_of(spark, f"{root}/{target}")
        if not files.exists(path):
            kind = T.StructType.fromDDL(absent) if isinstance(absent, str) else absent
            return spark.createDataFrame([], kind)
        return reader(spark, f"{root}/{target}", overrides)
    tables = {}
    for name in list_tables(spark, root):
        path = f"{root}/{name}"
        try:
            header = spark.read.csv(path, header=True, **QUOTING).columns
            own = {c: t for c, t in (overrides or {}).items() if c in header}
            tables[name] = reader(spark, path, own)
        except PySparkException as error:
            if failed is None:
                raise
            failed[name] = str(error)
    return tables

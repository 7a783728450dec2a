"""Text-first readers, source inspection, COPY lines and run records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablesense.functions import text as X
from tablesense.session import drop_binary, row_counts

#: Suffixes each loader takes.
SUFFIXES = {".csv": ",", ".tsv": "\t", ".txt": "\t", ".parquet": None, ".json": None, ".jsonl": None}


def safe_columns(spark: SparkSession, names: Sequence[str]) -> list[str]:
    """Header labels as safe, unique column names; blanks become ``col_<n>``."""
    rows = spark.createDataFrame(list(enumerate(names)), "i int, label string").select("i", X.safe_name(F.coalesce("label", F.lit(""))).alias("n")).collect()
    seen: dict[str, int] = {}
    out = []
    for row in sorted(rows, key=lambda r: r.i):
        name = row.n or f"col_{row.i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def load_delimited(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Every cell as text, no type guessing, header names made safe and unique.

    A quoted cell may hold line ends.  Large files without such cells can be split among tasks with
    ``multi_line=False``.
    """
    raw = (
        spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("multiLine", multi_line)
        .option("escape", '"').csv(path)
    )
    return raw.toDF(*safe_columns(spark, raw.columns))


def load_source(spark: SparkSession, path: str) -> DataFrame:
    """Pick the loader by suffix."""
    suffix = next((s for s in SUFFIXES if path.rstrip("/").lower().endswith(s)), None)
    if suffix is None:
        raise ValueError(f"unsupported source {path!r}; supported: {', '.join(SUFFIXES)}")
    if suffix == ".parquet":
        return drop_binary(spark.read.parquet(path))
    if suffix in (".json", ".jsonl"):
        return drop_binary(spark.read.json(path))
    return load_delimited(spark, path, SUFFIXES[suffix])


def scan_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table through Spark's own reader; pass partitionColumn and bounds to split it."""
    return drop_binary(spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load())


def scan_table(df: DataFrame, row_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, one-row flag).  Without a limit the whole table is read; with one, limit + 1 tells truncation."""
    kept = drop_binary(df)
    if row_limit is None:
        return kept, df.sparkSession.range(1).select(F.lit(False).alias("truncated"))
    probe = kept.limit(row_limit + 1)
    return kept.limit(row_limit), probe.agg((F.count(F.lit(1)) > row_limit).alias("truncated"))


def inspect_source(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: declared type, nullability, and the table's exact row count."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, f.name, i, f.dataType.simpleString(), f.nullable, isinstance(f.dataType, T.BinaryType))
        for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    columns = spark.createDataFrame(rows, "table_name string, column_name string, position int, declared_type string, nullable boolean, is_binary boolean")
    return columns.join(F.broadcast(row_counts(tables)), "table_name")


_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b"}


def decode_copy_field(c: Column) -> Column:
    r"""``\N`` as null; backslash pairs as the character they stand for, each pair read once."""
    pairs = F.regexp_extract_all(c, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    table = F.create_map(*[F.lit(x) for k, v in _ESCAPES.items() for x in (k, v)])

    def decoded(p: Column) -> Column:
        letter = p.substr(F.lit(2), F.lit(1))
        pair = p.startswith("\\") & (F.length(p) == 2)
        return F.when(pair, F.coalesce(F.try_element_at(table, letter), letter)).otherwise(p)

    plain = F.when(~c.contains("\\"), c).otherwise(F.array_join(F.transform(pairs, decoded), ""))
    return F.when(c != "\\N", plain)


def decode_copy_lines(lines: DataFrame, column: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, one-row count of malformed lines) from tab-separated COPY text."""
    parts = lines.select(F.split(F.col(column), "\t", -1).alias("_f"))
    good = F.size("_f") == len(names)
    rows = parts.where(good).select(*[decode_copy_field(F.get("_f", F.lit(i))).alias(n) for i, n in enumerate(names)])
    return rows, parts.agg(F.count_if(~good).alias("malformed"))


RECORD_KEY = ("arm", "db_id", "question_id")


def load_records(lines: DataFrame, schema: str, column: str = "value", position: str = "position", key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """Run records from JSON lines: torn lines skipped, the last line of a key wins.

    ``position`` is the line's place in the input, carried from the reader.  The last
    record per key is a grouped maximum, so a key repeated millions of times is cheap.
    """
    parsed = lines.select(position, F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r")).where(
        F.col("r").isNotNull() & F.col(f"r.{key[0]}").isNotNull())
    return parsed.groupBy(*[F.col(f"r.{k}").alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by("r", position).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value): text lines in file order, ordered by file, split of the file and place in the split."""
    return spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")).alias("position"), "value")


def preview(df: DataFrame, rows: int = 25) -> DataFrame:
    return df.limit(rows)

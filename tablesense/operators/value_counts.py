"""The shared core: distinct values with counts, and which columns hold each value.

Two forms, both with full map-side combine, so a value that fills a third of all
rows is one row per map task before anything is shuffled:

* ``value_counts``      one row per (column, value) with its count
* ``value_signatures``  one row per *set of columns*, with the number of distinct
  values found in exactly that set.  All pairwise overlaps follow from it by
  arithmetic on a handful of rows; no self join of values is ever made.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablesense.session import family, is_fractional, is_scalar, spread

#: Column flags per 64-bit word (the sign bit is left alone).
WORD = 62


@dataclass(frozen=True)
class ColumnRef:
    cid: int
    table: str
    column: str
    position: int
    data_type: T.DataType

    @property
    def family(self) -> str:
        return family(self.data_type)

    @property
    def fractional(self) -> bool:
        return is_fractional(self.data_type)


def column_refs(tables: Mapping[str, DataFrame]) -> list[ColumnRef]:
    refs: list[ColumnRef] = []
    for table, df in tables.items():
        for position, field in enumerate(df.schema.fields):
            if is_scalar(field.dataType):
                refs.append(ColumnRef(len(refs), table, field.name, position, field.dataType))
    return refs


def column_catalogue(spark: SparkSession, refs: list[ColumnRef]) -> DataFrame:
    rows = [
        (r.cid, r.table, r.column, r.position, r.data_type.simpleString(), r.family, r.fractional)
        for r in refs
    ]
    return spark.createDataFrame(
        rows,
        "cid int, table_name string, column_name string, position int, storage string, "
        "family string, fractional boolean",
    )


def cell_text(c: Column, data_type: T.DataType) -> Column:
    """A cell as comparison text: whole floats lose ``.0``, NaN is a blank, text is trimmed."""
    if is_fractional(data_type):
        x = c.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.cast("bigint").cast("string")).when(~F.isnan(x), x.cast("string"))
    return c.cast("string")


def equality_key(text: Column) -> Column:
    """Text for equality only: values over 64 characters travel as a 128-bit digest."""
    return F.when(F.length(text) > 64, F.concat(F.lit("\x01"), F.md5(text.cast("binary")))).otherwise(text)


def row_digest(columns: list[Column]) -> Column:
    """128 bits over all columns; blanks are hashed by position, so they count as values."""
    flagged = [x for c in columns for x in (c, c.isNull())]
    return F.struct(
        F.xxhash64(*flagged).alias("d1"), F.xxhash64(F.lit(7919), *flagged).alias("d2")
    )


def long_cells(df: DataFrame, refs: list[ColumnRef]) -> DataFrame:
    """(cid, value) rows of one table, blanks left out."""
    cells = F.array(*[
        F.struct(F.lit(r.cid).alias("cid"), cell_text(F.col(f"`{r.column}`"), r.data_type).alias("value"))
        for r in refs
    ])
    narrow = df.select(*[F.col(f"`{r.column}`") for r in refs])
    return spread(narrow).select(F.inline(cells)).where(F.col("value").isNotNull())


def value_counts(tables: Mapping[str, DataFrame], refs: list[ColumnRef] | None = None) -> DataFrame:
    """(cid, value, n): one shuffle for each way of storing values.

    Cells are counted as they are stored, and only what is distinct is written as text: a column's
    cells have equal text exactly when they are equal as doubles, integers or moments.
    """
    refs = refs or column_refs(tables)
    kinds = sorted({_stored(r.data_type) for r in refs})
    counted = [_counts_of_kind(tables, [r for r in refs if _stored(r.data_type) == kind], kind) for kind in kinds]
    return reduce(DataFrame.unionAll, counted)


def _stored(data_type: T.DataType) -> str:
    """The type a column's cells are counted in."""
    if is_fractional(data_type):
        return "double"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp_ntz"  # what the cell shows, in the session's time zone
    return "bigint" if isinstance(data_type, T.IntegralType) else "string"


def _counts_of_kind(tables: Mapping[str, DataFrame], refs: list[ColumnRef], kind: str) -> DataFrame:
    parts = []
    for name, df in tables.items():
        if mine := [r for r in refs if r.table == name]:
            cells = F.array(*[F.struct(F.lit(r.cid).alias("cid"), F.col(f"`{r.column}`").cast(kind).alias("x")) for r in mine])
            narrow = spread(df.select(*[F.col(f"`{r.column}`") for r in mine]))
            parts.append(narrow.select(F.inline(cells)).where(F.col("x").isNotNull()))
    counts = reduce(DataFrame.unionAll, parts).groupBy("cid", "x").agg(F.count(F.lit(1)).alias("n"))
    text = cell_text(F.col("x"), T.DoubleType() if kind == "double" else T.StringType())
    return counts.select("cid", text.alias("value"), "n").where(F.col("value").isNotNull())


def _words(count: int) -> list[str]:
    return [f"w{i}" for i in range((count + WORD - 1) // WORD)]


def value_masks(tables: Mapping[str, DataFrame], refs: list[ColumnRef], group: str) -> DataFrame:
    """(value, w0, w1, …): bit i of the words says whether column i holds the value.

    Numeric and datetime columns are compared natively, text columns as trimmed text.
    """
    words = _words(len(refs))
    cast = {"numeric": "bigint", "datetime": "timestamp_ntz"}.get(group, "string")
    if group == "numeric" and not all(isinstance(r.data_type, T.IntegralType) for r in refs):
        cast = "string"  # whole floats must equal integers, digit for digit
    slot = {r.cid: i for i, r in enumerate(refs)}
    parts = []
    for name, df in tables.items():
        mine = [r for r in refs if r.table == name]
        if not mine:
            continue
        cells = F.array(*[
            F.struct(
                *[F.lit((1 << (slot[r.cid] % WORD)) if slot[r.cid] // WORD == k else 0).cast("bigint").alias(w)
                  for k, w in enumerate(words)],
                (equality_key(F.btrim(cell_text(F.col(f"`{r.column}`"), r.data_type))) if cast == "string"
                 else F.col(f"`{r.column}`").cast(cast)).alias("value"),
            )
            for r in mine
        ])
        narrow = df.select(*[F.col(f"`{r.column}`") for r in mine])
        parts.append(spread(narrow).select(F.inline(cells)).where(F.col("value").isNotNull()))
    cells = reduce(DataFrame.unionAll, parts)
    return cells.groupBy("value").agg(*[F.bit_or(w).alias(w) for w in words])


def has_bit(slot: int) -> Column:
    """Does a mask row hold column ``slot``?"""
    return F.col(f"w{slot // WORD}").bitwiseAND(F.lit(1 << (slot % WORD)).cast("bigint")) != 0


def value_signatures(tables: Mapping[str, DataFrame], refs: list[ColumnRef], group: str) -> DataFrame:
    """(slots, values_): how many distinct values occur in exactly that set of columns."""
    words = _words(len(refs))
    counted = value_masks(tables, refs, group).groupBy(*words).agg(F.count(F.lit(1)).alias("values_"))
    slots = F.array_compact(F.array(*[F.when(has_bit(i), F.lit(i)) for i in range(len(refs))]))
    return counted.select(slots.alias("slots"), "values_")


def overlaps(
    tables: Mapping[str, DataFrame], refs: list[ColumnRef], targets: set[int] | None = None
) -> DataFrame:
    """(left_cid, right_cid, matched): distinct values shared, left side paired with itself too.

    ``targets`` keeps only those right-hand columns.  Pairs are formed between
    *columns* inside a signature row (as many as the schema is wide), never
    between values or rows.
    """
    out = None
    for group in sorted({r.family for r in refs}):
        mine = [r for r in refs if r.family == group]
        ids = F.array(*[F.lit(r.cid) for r in mine])
        sig = value_signatures(tables, mine, group)
        cids = F.transform(F.col("slots"), lambda s: F.element_at(ids, s + 1))
        rights = cids if targets is None else F.filter(
            cids, lambda c: c.isin(*targets) if targets else F.lit(False)
        )
        pairs = (
            sig.select(F.explode(cids).alias("left_cid"), rights.alias("rights"), "values_")
            .select(
                "left_cid",
                F.explode(F.array_distinct(F.concat("rights", F.array("left_cid")))).alias("right_cid"),
                "values_",
            )
            .groupBy("left_cid", "right_cid").agg(F.sum("values_").alias("matched"))
        )
        out = pairs if out is None else out.unionAll(pairs)
    return out


def non_null_counts(tables: Mapping[str, DataFrame], refs: list[ColumnRef]) -> dict[int, tuple[int, int]]:
    """cid -> (rows, non-null rows): one narrow aggregate per table, one job for all."""
    parts = []
    for name, df in tables.items():
        mine = [r for r in refs if r.table == name]
        if not mine:
            continue
        counts = df.agg(
            F.count(F.lit(1)).alias("rows_"),
            *[F.count(F.nanvl(F.col(f"`{r.column}`").cast("double"), F.lit(None).cast("double"))
                      if r.fractional else F.col(f"`{r.column}`")).alias(f"c{r.cid}") for r in mine],
        )
        parts.append(counts.select(
            F.col("rows_"),
            F.inline(F.array(*[
                F.struct(F.lit(r.cid).alias("cid"), F.col(f"c{r.cid}").alias("non_null")) for r in mine
            ])),
        ))
    return {row.cid: (row.rows_, row.non_null) for row in reduce(DataFrame.unionAll, parts).collect()}


@dataclass(frozen=True)
class ColumnEvidence:
    """Counts about columns: what is left of the data once it has been aggregated."""

    refs: list[ColumnRef]
    #: cid -> (rows of its table, non-blank rows)
    filled: dict[int, tuple[int, int]]
    #: (cid, cid) -> distinct values the two columns share, text without blanks at its ends
    shared: dict[tuple[int, int], int]
    #: cid -> distinct values as they stand, for columns whose text has blanks at its ends
    padded: dict[int, int] = field(default_factory=dict)

    def rows(self, table: str) -> int:
        return next((self.filled[r.cid][0] for r in self.refs if r.table == table), 0)

    def distinct(self, ref: ColumnRef) -> int:
        """Distinct values as references compare them."""
        return self.shared.get((ref.cid, ref.cid), 0)

    def distinct_raw(self, ref: ColumnRef) -> int:
        """Distinct values as they stand, as keys and dependencies group them."""
        return self.padded.get(ref.cid, self.distinct(ref))


def gather_evidence(tables: Mapping[str, DataFrame]) -> ColumnEvidence:
    """Two jobs for a whole dataset: filled cells, and shared distinct values.

    A third counts distinct values as they stand, of those text columns only where some value has
    blanks at its ends (the first job tells).  Fractional columns can be neither keys nor references, so their values are
    not shuffled at all.
    """
    refs = column_refs(tables)
    whole = [r for r in refs if not r.fractional]
    pairs = overlaps(tables, whole).collect() if whole else []
    text = [r for r in whole if r.family == "text"]
    wide = padded_columns(tables, text) if text else set()
    return ColumnEvidence(
        refs, non_null_counts(tables, refs), {(r.left_cid, r.right_cid): r.matched for r in pairs},
        raw_distinct(tables, [r for r in text if r.cid in wide]),
    )


def padded_columns(tables: Mapping[str, DataFrame], refs: list[ColumnRef]) -> set[int]:
    """Text columns with a value that begins or ends with a blank: one narrow aggregate per table."""
    parts = []
    for name, df in tables.items():
        mine = [r for r in refs if r.table == name]
        if mine:
            text = [cell_text(F.col(f"`{r.column}`"), r.data_type) for r in mine]
            flags = df.agg(*[F.max((F.octet_length(F.btrim(t)) < F.octet_length(t)).cast("int")).alias(f"c{r.cid}") for r, t in zip(mine, text)])
            parts.append(flags.select(F.inline(F.array(*[F.struct(F.lit(r.cid).alias("cid"), F.col(f"c{r.cid}").alias("padded")) for r in mine]))))
    return {r.cid for r in reduce(DataFrame.unionAll, parts).where("padded = 1").collect()}


def raw_distinct(tables: Mapping[str, DataFrame], refs: list[ColumnRef]) -> dict[int, int]:
    """cid -> distinct values as they stand."""
    parts = [
        long_cells(df, mine).select("cid", equality_key(F.col("value")).alias("value"))
        for name, df in tables.items() if (mine := [r for r in refs if r.table == name])]
    if not parts:
        return {}
    counted = reduce(DataFrame.unionAll, parts).distinct().groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return {r.cid: r.n for r in counted.collect()}

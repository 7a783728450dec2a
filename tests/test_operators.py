"""Operators on small literal frames; expected values worked out from the rules."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tablesense import values as V
from tablesense.functions import dates, ratios, text as X
from tablesense.operators import (
    clean, compare as CMP, dependencies as FD, duplicates, equivalence, foreign_keys as FK, fuzzy, keys as K, labels, plan,
    profile as P, publish as PB, ranks, retrieve as R, runs, sample as SM, settle, steps as ST, table_profile as TP, triage,
)
from tablesense.operators.column_types import column_types
from tablesense.operators.ranks import exact_medians, number_rows, select_ranks, spacing
from tablesense.operators.value_counts import column_refs, gather_evidence, value_counts
from tablesense.session import row_counts
from tablesense.sources import readers, versions


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, expression, value, kind="string"):
    return frame(spark, [(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first().x


# --- text ---------------------------------------------------------------------
@pytest.mark.parametrize("value", [*V.NULL_TOKENS, " N/A ", "Unknown", " na "])
def test_null_markers(spark, value):
    assert one(spark, X.is_null_token, value)


@pytest.mark.parametrize("value", ["0", "no", "n / a", "zero"])
def test_not_null_markers(spark, value):
    assert not one(spark, X.is_null_token, value)


@pytest.mark.parametrize("value, want", [
    ("৳1,200.00", 1200.0), ("$45.50", 45.5), ("(1,200)", -1200.0), ("1 200", 1200.0), ("1,20,000", None), ("Tk 5", 5.0),
    ("R$ 5", None), ("$5€", None), ("1_000", 1000.0), ("1d", None), ("1e3", 1000.0), ("-inf", float("-inf")), ("০১২", 12.0), (".", None), ("abc", None),
])
def test_numbers(spark, value, want):
    assert one(spark, X.to_number, value) == want


def test_currency_text(spark):
    assert one(spark, X.strip_currency, "(৳ 1,200)") == "-1200"
    assert one(spark, X.currency_symbol, "R$5") == "$"


@pytest.mark.parametrize("value, want", [("5%", 0.05), (" 12.5 % ", 0.125), ("5", None), ("a%", None), ("1,000%", 10.0)])
def test_percents(spark, value, want):
    assert one(spark, X.parse_percent, value) == want


@pytest.mark.parametrize("value, want", [
    ("2024-01-15", "2024-01-15"), ("16/01/2024", "2024-01-16"), ("06/05/2021", "2021-05-06"), ("01/16/2024", "2024-01-16"), ("31/02/2024", None),
    ("5 Jan 2020", "2020-01-05"), ("january 5 2020", None), ("Jan 5, 2020", "2020-01-05"), ("01/01/69", "1969-01-01"), ("01/01/68", "2068-01-01"),
    ("1/2/03", "2003-02-01"), ("2024-01-15 10:20:30", "2024-01-15"), ("20240115", None), ("005/01/2020", None), ("ORD-1001", None),
])
def test_dates(spark, value, want):
    got = one(spark, dates.parse_date, value)
    assert (got and got.date().isoformat()) == want


def test_title_matches_python(spark):
    for value in ["o'neil mcdonald-smith", "ÉCOLE normale", "a1b c", "MEN-1234", "বাংলা abc"]:
        assert one(spark, X.title_case, value) == value.title()


@pytest.mark.parametrize("value, want", [("ORD-1001", "a-9"), ("৳1,200.00", "৳9"), ("Order ID", "a a"), ("  ", "")])
def test_shapes(spark, value, want):
    assert one(spark, X.value_shape, value) == want


def test_names(spark):
    assert one(spark, X.safe_name, "Unit Price (%) / #2") == "unit_price_pct_no_2"
    assert one(spark, X.sql_identifier, "Prénom Élève") == "prenom_eleve"
    assert one(spark, X.sql_identifier, "Order") == "order_col"
    assert one(spark, X.sql_identifier, "2024 total") == "c_2024_total"
    assert one(spark, X.sql_identifier, "বাংলা") == "column"
    assert one(spark, X.normalise_name, "custID") == "customer identifier"
    assert one(spark, X.question_terms, "What were the total orders shipped, by shipping?") == ["total", "order", "shipp"]
    assert one(spark, lambda c: X.rename_words(c, {"id": "key", "order id": "order_key"}), "Order ID or id, not idle") == "order_key or key, not idle"


def test_ratios_against_brute_force():
    random.seed(4)
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]
    for _ in range(200):
        a, b = ("".join(random.choices("abcd", k=random.randint(0, 12))) for _ in range(2))
        assert ratios.lcs_length(a, b) == slow(a, b)
    assert ratios.lexical_similarity_of("customer identifier", "customer identifier") == 1.0
    assert 0.6 < ratios.lexical_similarity_of("customer identifier", "order identifier") < 0.8


def test_fuzzy_against_brute_force(spark):
    random.seed(7)
    keys = [f"Customer#{i:09d}" for i in range(40)] + ["x" * 30 + f"{i:02d}" + "tail" for i in range(10)] + ["ab", "abc"]
    orphans = []
    for k in keys:
        i = random.randrange(len(k))
        orphans += [k[:i] + k[i + 1:], k[:i] + "?" + k[i:], k[:i] + "#" + k[i + 1:]]
    orphans = sorted(set(orphans))
    want = {(o, k) for o in orphans for k in keys if ratios.indel_ratio(o, k) >= 90}
    got = fuzzy.fuzzy_matches(frame(spark, [(o,) for o in orphans], "value string"), frame(spark, [(k,) for k in keys], "value string"))
    assert {(r.orphan, r.key) for r in got.collect()} == want


# --- keys, references, dependencies -------------------------------------------
def test_keys(spark):
    tables = {
        "single": frame(spark, [(f"O-{i}", "x") for i in range(30)], "order_id string, city string"),
        "blank": frame(spark, [(None if i == 3 else f"C{i}", i) for i in range(10)], "code string, seq int"),
        "measure": frame(spark, [(i + 0.5, "a") for i in range(10)], "amount double, kind string"),
        "pair": frame(spark, [(o, l, "z") for o in range(6) for l in range(4)], "order_no int, line int, note string"),
        "copies": frame(spark, [(1, "a"), (1, "a"), (2, "b")], "id int, v string"),
    }
    found = K.discover_keys(tables)
    assert found["single"].primary_key == ["order_id"]
    assert found["blank"].primary_key == ["seq"]
    assert found["measure"].needs_synthetic_key and not found["measure"].primary_key
    assert found["pair"].candidates == [["order_no", "line"]] and found["pair"].needs_confirmation and not found["pair"].primary_key
    assert found["copies"].duplicate_rows == 1 and found["copies"].primary_key == ["id"]
    assert K.discover_keys(tables, {"pair": ["order_no"]})["pair"].declared_key_holds is False
    assert K.discover_keys(tables, {"pair": ["order_no", "line"]})["pair"].source == "declared"


def shop(spark):
    customers = frame(spark, [(f"C-{i:03d}", f"n{i}", f"city{i % 5}", f"region{i % 5 % 2}") for i in range(30)], "customer_id string, name string, city string, region string")
    orders = frame(spark, [(1000 + i, "C-900" if i in (7, 23) else f"C-{i % 25:03d}", ["new", "paid", "sent"][i % 3]) for i in range(45)], "order_id int, customer_id string, status string")
    return {"customers": customers, "orders": orders}


def test_foreign_keys(spark):
    tables = shop(spark)
    found = FK.foreign_keys(spark, tables, {"customers": "customer_id", "orders": "order_id"}).collect()
    row = next(r for r in found if r.from_table == "orders")
    assert (row.from_column, row.to_table, row.to_column, row.matched, row.source_distinct) == ("customer_id", "customers", "customer_id", 24, 25)
    assert abs(row.score - min(1.0, 0.7 * 24 / 25 + 0.3 * 24 / 30 + 0.2)) < 1e-9
    orphans = FK.orphan_samples(tables, [("orders", "customer_id", "customers", "customer_id")]).collect()
    assert [r.orphan for r in orphans] == ["C-900"]
    declared = frame(spark, [("orders", "customer_id", "customers", "customer_id")], "from_table string, from_column string, to_table string, to_column string")
    merged = FK.foreign_keys(spark, tables, {"customers": "customer_id"}, declared).where("from_table = 'orders'").collect()
    assert [(r.origin, r.score) for r in merged] == [("declared", 1.0)]


def unique_sets(rows, columns, depth):
    """Column sets of one depth without a repeat, by counting."""
    return {c for c in itertools.combinations(columns, depth) if len({tuple(r[k] for k in c) for r in rows}) == len(rows)}


@pytest.mark.parametrize("shares", [50, 400, 20_000])
def test_composite_keys_of_wide_tables(spark, shares):
    rng = random.Random(shares)
    columns = [f"c{i}" for i in range(14)] + ["order_id", "line_no"]
    rows = [{**{f"c{i}": rng.randrange((3, 40, 300)[i % 3]) for i in range(14)}, "order_id": n // 40, "line_no": n % 40} for n in range(1200)]
    for r in rows[:400]:
        r["c2"] = 7  # one value on a third of the rows
    df = frame(spark, [tuple(r.values()) for r in rows], ", ".join(f"{c} int" for c in columns))
    distinct = {c: len({r[c] for r in rows}) for c in columns}
    pairs, triples = (K.composite_keys(df, distinct, len(rows), n, sample_rows=shares) for n in (2, 3))
    assert {tuple(sorted(c, key=columns.index)) for c in pairs} == unique_sets(rows, columns, 2) == {("order_id", "line_no")}
    held = unique_sets(rows, columns, 3)
    assert len(triples) == min(V.MAX_CANDIDATES, len(held)) and {tuple(sorted(c, key=columns.index)) for c in triples} <= held
    assert all({"order_id", "line_no"} <= set(c) for c in triples)


def test_forty_columns_without_a_pair(spark):
    wide = spark.range(30_000).select(
        *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit((7, 50, 300)[k % 3])).alias(f"c{k}") for k in range(37)],
        (F.col("id") % 30).alias("order_id"), (F.floor(F.col("id") / 30) % 50).alias("line_no"), F.floor(F.col("id") / 1500).alias("batch_no"))
    found = K.discover_keys({"t": wide})["t"]
    rows = [r.asDict() for r in wide.collect()]
    assert not unique_sets(rows, wide.columns, 2)
    assert sorted(found.candidates[0]) == ["batch_no", "line_no", "order_id"]
    assert all(len({tuple(r[c] for c in cols) for r in rows}) == len(rows) for cols in found.candidates)


def test_dependencies(spark):
    found = {(r.determinant, r.dependent): r for r in FD.dependencies(spark, shop(spark), {"customers": ["customer_id"]}).collect()}
    assert found[("city", "region")].exact
    assert ("region", "city") not in found
    once = frame(spark, [(i, "a" if i % 2 else "b") for i in range(30)], "a int, b string")
    assert FD.dependencies(spark, {"t": once}).count() == 0
    assert FD.longest_path({"a": {"b"}, "b": {"c", "a"}, "x": {"c"}, "c": set()}) == ["a", "b", "c"]


def test_sampling_never_changes_dependencies(spark):
    rows = [(i % 50, i % 50 % 7, (i * 7919) % 13, i % 50 if i % 1000 else -1) for i in range(6000)]
    df = {"t": frame(spark, rows, "a int, b int, c int, d int")}
    full = {tuple(r) for r in FD.dependencies(spark, df, sample_rows=10**9).collect()}
    assert {tuple(r) for r in FD.dependencies(spark, df, sample_rows=500).collect()} == full


def test_settling(spark):
    rows = [("a", "x_id", "b", "id", 0.99, "detected", 1.0, 0.9, 50), ("b", "id", "a", "x_id", 0.97, "detected", 1.0, 0.9, 50),
            ("a", "y", "b", "id", 0.8, "detected", 1.0, 0.5, 50), ("a", "z", "c", "id", 0.9, "detected", 0.92, 0.5, 50), ("a", "q", "c", "id", 0.9, "detected", 1.0, 0.1, 50)]
    df = frame(spark, rows, "from_table string, from_column string, to_table string, to_column string, score double, origin string, ratio_overlap double, name_similarity double, target_distinct int")
    got = {r.from_column: r.status for r in settle.settle_foreign_keys(spark, df).collect()}
    assert got == {"x_id": "confirmed", "id": "rejected", "y": "rejected", "z": "proposed", "q": "rejected"}


def test_equivalences(spark):
    tables = {"a": frame(spark, [(f"C{i}",) for i in range(5)], "cust_id string"), "b": frame(spark, [(f"C{i}", i) for i in range(5)], "customer_id string, qty int")}
    got = equivalence.equivalences(spark, tables).collect()
    assert [(r.left_column, r.right_column, r.verdict) for r in got] == [("cust_id", "customer_id", "linked")]


# --- cleaning -----------------------------------------------------------------
def test_clean_table(spark):
    rows = [(f"৳{i},200", "12%" if i < 9 else "n/a", "06/15/2021" if i % 2 else "06/05/2021", "0171122", f" s{i} ") for i in range(10)]
    cleaned, report = clean.clean_table(frame(spark, rows, "amount string, rate string, day string, phone string, label string"))
    first = cleaned.first()
    assert (first.amount, first.rate, first.day, first.phone, first.label) == (200, 0.12, dt.datetime(2021, 6, 5), "0171122", "s0")
    assert dict(cleaned.dtypes) == {"amount": "bigint", "rate": "double", "day": "timestamp_ntz", "phone": "string", "label": "string"}
    kinds = {r.column_name: r.kind for r in report.collect()}
    assert kinds == {"amount": "numeric", "rate": "percent", "day": "date", "phone": "text", "label": "text"}


def test_steps_never_fill_blanks(spark):
    df = frame(spark, [("a ", None, "1"), (None, "X", "two"), ("A", "x", None)], "p string, q string, r string")
    blanks = lambda d: d.select([F.count_if(F.col(c).isNull()).alias(c) for c in ("p", "q", "r")]).first().asDict()
    before = blanks(df)
    steps = [ST.Step("strip_whitespace", "t", {"column": "p"}), ST.Step("standardize_casing", "t", {"column": "q", "casing": "lower"}),
             ST.Step("type_cast", "t", {"column": "r", "to": "numeric"}), ST.Step("standardize_format", "t", {"column": "p", "format": "upper"})]
    for step in steps:
        after = blanks(ST.apply_step({"t": df}, step)["t"])
        assert all(after[c] >= before[c] for c in before)
    for name in V.FORBIDDEN_STEPS:
        with pytest.raises(ST.StepError):
            ST.apply_step({"t": df}, ST.Step(name, "t", {"column": "p"}))


def test_steps(spark):
    df = frame(spark, [(1, "a", "x,y,z"), (2, "a", "q"), (3, "b", None)], "i int, k string, s string")
    assert sorted(r.i for r in ST.deduplicate(df, ["k"], "first", ["i"]).collect()) == [1, 3]
    assert sorted(r.i for r in ST.deduplicate(df, ["k"], "last", ["i"]).collect()) == [2, 3]
    assert [r.i for r in ST.deduplicate(df, ["k"], False).collect()] == [3]
    parts = {r.i: (r.m, r.n) for r in ST.split_column(df, "s", ["m", "n"], ",").collect()}
    assert parts == {1: ("x", "y,z"), 2: ("q", None), 3: (None, None)}
    with pytest.raises(ST.StepError):
        ST.drop_column(df.select("i"), "i")
    left, right = frame(spark, [(1, "l"), (None, "m")], "k int, v string"), frame(spark, [(None, "r")], "k int, v string")
    assert sorted(map(tuple, ST.merge_tables(left, right, "k", "k", "left", "r").collect()), key=str) == sorted([(1, "l", None), (None, "m", "r")], key=str)
    kept, failed = ST.run_plan({"t": df}, [ST.Step("drop_column", "t", {"column": "nope"}), ST.Step("rename_column", "t", {"column": "k", "new_name": "kind"})])
    assert kept["t"].columns == ["i", "kind", "s"] and len(failed) == 1


def test_row_numbers_and_medians(spark):
    df = spark.range(0, 997).select(((F.col("id") * 7919) % 997).alias("x"))
    assert [(r.row_id, r.x) for r in number_rows(df, ["x"]).orderBy("row_id").collect()] == [(i + 1, i) for i in range(997)]
    random.seed(3)
    values = [random.choice([0.0, 1e9, random.gauss(0, 1), 5.0]) for _ in range(501)]
    long = frame(spark, [("g", v) for v in values] + [("h", 1.0), ("h", 2.0)], "group_id string, x double")
    got = exact_medians(long)
    assert got["g"] == sorted(values)[250] and got["h"] == 1.5


def test_spacing(spark):
    days = frame(spark, [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i),) for i in range(10)], "t timestamp_ntz")
    row = spacing(days, "t", buckets=3).first()
    assert (row.points, row.mean_seconds, row.std_seconds) == (10, 86400.0, 0.0)


def test_plan_and_triage(spark):
    tables = {"t": frame(spark, [(i, ["Shipped", "shipped", "Open "][i % 3], None) for i in range(9)], "id int, status string, empty string")}
    steps = plan.propose_plan(spark, tables)
    assert [(s.type, s.params.get("column")) for s in steps] == [("drop_column", "empty"), ("strip_whitespace", "status"), ("standardize_casing", "status")]
    assert steps[-1].params["casing"] == "title"
    catalogue = frame(spark, [("t", "id", 0.0), ("t", "status", 0.6), ("t", "empty", 1.0)], "table_name string, column_name string, null_ratio double")
    found = triage.issues(row_counts(tables), catalogue)
    assert {r.code for r in found.collect()} == {"high_null_ratio", "empty_columns"}
    assert triage.statuses(row_counts(tables), found).first().status == "needs_attention"


def test_duplicate_tables(spark):
    a = frame(spark, [(1, None), (2, "x")], "i int, s string")
    b = frame(spark, [(2, "x"), (1, None)], "i int, s string")
    c = frame(spark, [(1, "x"), (2, None)], "i int, s string")
    got = duplicates.duplicate_tables(spark, {"t_2": b, "t": a, "u": c}).collect()
    assert [tuple(r) for r in got] == [("t_2", "t")]


# --- types, labels, table types -----------------------------------------------
def test_types_and_labels(spark):
    rows = [(f"a{i}@x.org", f"SKU-{i:04d}", i * 10, 19.5 + i, i % 3, "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", f"0{i}7") for i in range(40)]
    t = {"t": frame(spark, rows, "email string, item_code string, ladder int, unit_price double, qty int, active string, created string, zip string")}
    counts = value_counts(t)
    got = {r.column_name: (r.column_type, r.taxonomy_label) for r in labels.label_columns(column_types(spark, t, counts=counts), counts).collect()}
    assert got == {
        "email": ("text", "email"), "item_code": ("identifier", "sku"), "ladder": ("integer_ordinal", "unknown"), "unit_price": ("currency", "price"),
        "qty": ("integer_nominal", "quantity"), "active": ("boolean", "boolean_flag"), "created": ("date", "unknown"), "zip": ("identifier", "postal_code")}


def test_table_types(spark):
    columns = frame(spark, [
        ("sales", "sale_id", 0, "identifier", "identifier", 100, 1.0, 0.0), ("sales", "cust_id", 1, "integer_continuous", "identifier", 30, 0.3, 0.0),
        ("sales", "amount", 2, "currency", "revenue", 90, 0.9, 0.0), ("custs", "cust_id", 0, "identifier", "identifier", 30, 1.0, 0.0),
        ("custs", "name", 1, "text", "person_name", 30, 1.0, 0.0), ("links", "a_id", 0, "identifier", "identifier", 9, 0.5, 0.0), ("links", "b_id", 1, "identifier", "identifier", 9, 0.5, 0.0),
    ], "table_name string, column_name string, position int, column_type string, taxonomy_label string, unique_count int, unique_ratio double, null_ratio double")
    tables = frame(spark, [("sales", 100), ("custs", 30), ("links", 40)], "table_name string, row_count int")
    keys = frame(spark, [("sales", "sale_id"), ("custs", "cust_id")], "table_name string, column_name string")
    edges = frame(spark, [("foreign_key", "sales", "cust_id", "custs", "cust_id", "confirmed"), ("foreign_key", "links", "a_id", "custs", "cust_id", "proposed"),
                          ("foreign_key", "links", "b_id", "sales", "sale_id", "proposed")], "rel_type string, from_table string, from_column string, to_table string, to_column string, status string")
    typed = TP.table_types(TP.table_labels(TP.table_features(spark, tables, columns, keys, edges)))
    got = {r.table_name: (r.table_type, set(r.labels)) for r in typed.collect()}
    assert {t: k for t, (k, _) in got.items()} == {"sales": "fact", "custs": "dimension", "links": "bridge"}
    assert "is_exactly_two_foreign_keys_existing" in got["links"][1] and "is_mostly_referenced" in got["custs"][1]
    override = frame(spark, [("sales", "wide", ["is_self_reference"], ["is_single_value_column"])], "table_name string, user_table_type string, added_labels array<string>, removed_labels array<string>")
    row = TP.with_overrides(typed, override).where("table_name = 'sales'").first()
    assert row.table_type == "fact" and row.effective_type == "wide" and "is_self_reference" in row.effective_labels and "is_single_value_column" not in row.effective_labels


def test_published_types(spark):
    t = {"t": frame(spark, [(3_000_000_000, 1.12345, "007", 5, "yes"), (1, 2.5, "010", 7, None)], "big bigint, money double, code string, nominal int, flag string")}
    types = frame(spark, [("t", "big", "integer_ordinal"), ("t", "money", "currency"), ("t", "code", "integer_continuous"), ("t", "nominal", "integer_nominal"), ("t", "flag", "boolean")],
                  "table_name string, column_name string, column_type string")
    declared = frame(spark, [("t", "nominal", "INTEGER"), ("t", "flag", "VARCHAR(3)")], "table_name string, column_name string, declared_type string")
    plan_ = PB.plan_types(PB.fit_facts(spark, t), types, declared)
    assert {r.column_name: r.sql_type for r in plan_.collect()} == {"big": "BIGINT", "money": "NUMERIC(15,6)", "code": "TEXT", "nominal": "INTEGER", "flag": "TEXT"}
    rows = sorted(PB.plan_names(spark, plan_).collect(), key=lambda r: r.position)
    assert [tuple(r) for r in PB.prepare_table(t["t"], rows).collect()][1][2:] == ("010", 7, None)


def test_histogram_like_numpy(spark):
    import numpy as np

    random.seed(1)
    values = [random.gauss(0, 10) for _ in range(300)] + [0.1 * i for i in range(50)]
    got = P.histogram(spark, {"t": frame(spark, [(v,) for v in values], "x double")}).orderBy("bin").collect()
    assert [r.n for r in got] == list(np.histogram(values, bins=10)[0])
    flat = P.histogram(spark, {"t": frame(spark, [(4.0,)] * 3, "x double")}).collect()
    assert [(r.lo, r.hi, r.n) for r in flat] == [(3.5, 4.5, 3)]


# --- comparison, sampling, plans ----------------------------------------------
def test_verdicts_are_nested(spark):
    gold = frame(spark, [(1, "2002-09-08", 0.1 + 0.2), (2, None, 3.0)], "a int, d string, x double")
    preds = {
        "same": gold, "text": frame(spark, [("1", "2002-09-08 00:00:00", "0.3"), ("2", None, "3")], "a string, d string, x string"),
        "wide": gold.withColumn("e", F.lit(1)), "wrong": gold.where("a = 1"), "narrow": gold.select("a")}
    got = {k: CMP.score(p, gold) for k, p in preds.items()}
    for s in got.values():
        assert (not s["strict"] or s["normalised"]) and (not s["normalised"] or s["relaxed"])
    assert got["same"]["strict"] and got["text"]["normalised"] and not got["text"]["strict"]
    assert got["wide"]["extra_columns"] == 1 and got["wide"]["relaxed"] and not got["wrong"]["relaxed_match"] and not got["narrow"]["relaxed_match"]


def test_sample_is_exact_and_stable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("s"))
    a = {r.id for r in SM.stratified_sample(df, ["s"], ["id"], 101).collect()}
    assert len(a) == 101 and a == {r.id for r in SM.stratified_sample(df.repartition(5), ["s"], ["id"], 101).collect()}
    assert SM.rest_of(df, df.where(F.col("id").isin(list(a))), ["id"]).count() == 899


def test_no_cartesian_and_no_lone_window(spark, data):
    from tablesense.session import load_tables

    li = load_tables(spark, data, ["lineitem"])["lineitem"]
    for df in (ST.deduplicate(li, ["l_orderkey"], "first", ["l_linenumber"]), K.key_violations(li, ["l_orderkey"]), K.duplicate_rows(li),
               P.top_values(value_counts({"l": li})), FD.dependency_evidence(li, "l_orderkey", "l_suppkey")):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    scan = K.key_violations(li, ["l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in scan


def test_top_values_prune_before_shuffle(spark, data):
    from tablesense.session import load_tables

    text = P.top_values(value_counts(load_tables(spark, data, ["part"])))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_recovered_and_nearest(spark):
    keys, lost = frame(spark, [("Customer#001",), ("Customer#002",)], "value string"), frame(spark, [("Custmer#001",), ("zzz",), (None,)], "value string")
    assert tuple(fuzzy.recovered(lost, keys).first()) == (2, 1)
    rows = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    got = R.nearest(rows.where("id < 3"), rows, "id", "id", "v", 1)
    assert sorted((r.query_id, r.id) for r in got.collect()) == [(1, 1), (2, 2)]
    plan_text = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan_text and "Cartesian" not in plan_text


# --- no caps, no switches -----------------------------------------------------
def test_padded_text_is_counted_as_it_stands(spark):
    df = frame(spark, [("a", 1), ("a ", 2), ("b", 2), (" b", 1), ("c", 1)], "k string, n int")
    found = K.discover_keys({"t": df})["t"]
    assert found.primary_key == ["k"] and K.is_key(df, ["k"])


def test_padded_determinants_on_both_sides_of_the_sample(spark):
    rows = [("v" + " " * (i % 10) + str(i % 100) + " " * (i // 100 % 10), "x" if i < 6 else str(i % 100 % 7)) for i in range(6000)]
    df = {"t": frame(spark, rows, "a string, b string")}
    full = {tuple(r) for r in FD.dependencies(spark, df, sample_rows=10**9).collect()}
    assert any(r[1:3] == ("a", "b") for r in full)
    assert {tuple(r) for r in FD.dependencies(spark, df, sample_rows=500).collect()} == full


def test_composite_key_in_a_wide_table(spark):
    rows = [(*[(i * (j + 3)) % 29 for j in range(12)], i // 5, i % 5) for i in range(100)]
    columns = [*[f"n{j}" for j in range(12)], "order_no", "line_no"]
    df = frame(spark, rows, ", ".join(f"{c} int" for c in columns))
    assert ["order_no", "line_no"] in [sorted(c, key=columns.index) for c in K.discover_keys({"t": df})["t"].candidates]


def test_ranks_with_infinities_end(spark):
    inf = float("inf")
    long = frame(spark, [("a", x) for x in (-inf, 1.0, 2.0, inf, inf)] + [("b", -1e308), ("b", 0.0), ("b", 1e308), ("c", inf)], "group_id string, x double")
    asked = [("a", k) for k in range(5)] + [("b", k) for k in range(3)] + [("c", 0)]
    got = select_ranks(long, asked)
    assert [got[q] for q in asked] == [-inf, 1.0, 2.0, inf, inf, -1e308, 0.0, 1e308, inf]


def test_names_are_unique_however_they_collide(spark):
    from tablesense.functions.naming import unique_names

    names = ["a", "a", "a_2", "a_2", "a_2_2", "a_2_2", "a_2_2_2", "a_2_2_2", "a_2_2_2_2", *["z" * 63] * 4, "z" * 61 + "_2"]
    got = [r.name for r in unique_names(frame(spark, [(1, i, n) for i, n in enumerate(names)], "t int, i int, n string"), ["t"], "i", "n", "name").collect()]
    assert len(set(got)) == len(names) and max(map(len, got)) <= 63


def test_columns_reproduce(spark):
    gold = frame(spark, [(i, i % 3, i % 3 + 10) for i in range(9)], "g0 int, g1 int, g2 int")
    pred = gold.select(F.col("g2").alias("p0"), F.col("g1").alias("p1"), F.col("g0").alias("p2"))
    assert CMP.columns_reproduce(pred, gold) is True
    swapped = frame(spark, [(i, (i + 1) % 3, i % 3 + 10) for i in range(9)], "p0 int, p1 int, p2 int")
    assert CMP.columns_reproduce(swapped, gold) is False


def test_nearest_without_questions(spark):
    rows = frame(spark, [(1, [1.0, 0.0])], "id int, v array<double>")
    assert R.nearest(rows.limit(0).withColumnRenamed("id", "q"), rows, "q", "id", "v", 3).count() == 0


def test_quoted_line_ends_stay_in_their_cell(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert sorted(tuple(r) for r in readers.load_delimited(spark, str(tmp_path / "t.csv")).collect()) == [("1", "x\ny"), ("2", "z")]


def test_lines_come_in_file_order(spark, tmp_path):
    (tmp_path / "r.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        got = [r.value for r in readers.read_lines(spark, str(tmp_path / "r.txt")).orderBy("position").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i}" for i in range(500)]


def test_dependencies_carry_only_what_is_alive(spark):
    wide = spark.range(4000).select(
        (F.col("id") % 40).alias("city"), (F.col("id") % 40 % 8).alias("zone"), (F.col("id") % 40 % 8 % 2).alias("half"),
        *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(30)).alias(f"noise{k}") for k in range(12)])
    found = {(r.determinant, r.dependent) for r in FD.dependencies(spark, {"t": wide}, sample_rows=300).collect()}
    assert found == {("city", "zone"), ("city", "half"), ("zone", "half")}
    counted = FD.witness_counts(wide, "t", {"city": ["zone", "half"], "noise1": ["noise2"]})
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "noise3" not in plan and "b1#" in plan and "b2#" not in plan
    assert {(r.determinant, r.dependent, r.witness_groups, r.consistent_witnesses) for r in counted.collect()} >= {("city", "zone", 40, 40), ("city", "half", 40, 40)}
    part = {(r.determinant, r.dependent): r.total_groups for r in FD.witness_counts(wide, "t", {"city": ["zone", "half"]}, 4).collect()}
    assert 0 < part[("city", "zone")] < 40


def test_best_match_by_all_pairs(spark):
    rng = random.Random(12)
    keys = ["".join(rng.choices("ab01", k=rng.choice([1, 5, 9, 12, 20, 24, 26, 40]))) for _ in range(60)] + ["customer#0001", "customer#0002", "", None]
    orphans = [None, "", "customer#001", "customer#0003", "zzzz"]
    for key in keys[:60]:
        text = list(key)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text) + 1)
            text[at:at + rng.randint(0, 1)] = rng.choices("ab01", k=rng.randint(0, 1))
        orphans.append("".join(text))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            before, row[0] = row[:], row[0] + 1
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] if x == y else 1 + min(before[j], row[j - 1])
        return row[-1]

    want = {}
    for o in {o for o in orphans if o is not None}:
        near = [(distance(o, k) / max(1, len(o) + len(k)), k) for k in keys if k is not None]
        if min(near)[0] <= 0.1 + 1e-12:
            want[o] = (min(near)[1], 100 - 100 * min(near)[0])
    got = fuzzy.best_matches(frame(spark, [(o,) for o in orphans], "value string"), frame(spark, [(k,) for k in keys], "value string")).collect()
    assert {r.orphan: r.key for r in got} == {o: k for o, (k, _) in want.items()} and len(got) == len(want)
    assert all(abs(r.ratio - want[r.orphan][1]) < 1e-9 for r in got)


def test_typos_on_weak_references(spark):
    tables = {"orders": frame(spark, [("cust-00001",), ("cust-00002",), ("cust-0000x3",), ("nothing alike",), (None,)], "cust string"),
              "customers": frame(spark, [(f"cust-0000{i}",) for i in range(1, 9)], "id string")}
    found = frame(spark, [("orders", "cust", "customers", "id", "fuzzy"), ("orders", "cust", "customers", "id", "detected")],
                  "from_table string, from_column string, to_table string, to_column string, origin string")
    assert [tuple(r)[4:] for r in fuzzy.recovered_references(spark, tables, found).collect()] == [(2, 1, "cust-0000x3 ~ cust-00003")]


def test_symmetric_columns_are_decided(spark):
    def bits(parity):
        return [tuple(n >> k & 1 for k in range(12)) for n in range(1 << 12) if n.bit_count() % 2 == parity][:: 1]

    schema = ", ".join(f"c{i} int" for i in range(12))
    even, odd = frame(spark, bits(0), schema), frame(spark, bits(1), schema)
    assert CMP.columns_reproduce(even, even.select(*[f"c{i}" for i in range(11, -1, -1)])) is True
    assert CMP.columns_reproduce(even, odd) is False  # any eleven columns agree, no choice of twelve does
    cycle = frame(spark, [(1, 2, 3), (2, 3, 1), (3, 1, 2)], "a int, b int, c int")
    assert CMP.columns_reproduce(cycle.select("c", "a", "b"), cycle) is True
    turned = frame(spark, [(2, 1, 3), (3, 2, 1), (1, 3, 2)], "a int, b int, c int")
    assert CMP.columns_reproduce(turned, cycle) is True and CMP.columns_reproduce(turned.limit(2), cycle) is False


def test_choices_of_columns_by_all_assignments(spark):
    rng = random.Random(9)
    for _ in range(12):
        rows = [tuple(rng.randrange(2) for _ in range(4)) for _ in range(rng.randint(2, 5))]
        gold = [tuple(rng.randrange(2) for _ in range(3)) for _ in range(3)] if rng.random() < 0.5 else [tuple(r[i] for i in rng.sample(range(4), 3)) for r in rows[:1]]
        if rng.random() < 0.6:
            pick = rng.sample(range(4), 3)
            gold = [tuple(r[i] for i in pick) for r in rows]
        want = any({tuple(r[i] for i in p) for r in rows} == set(gold) for p in itertools.permutations(range(4), 3))
        assert CMP.columns_reproduce(frame(spark, rows, "a int, b int, c int, d int"), frame(spark, gold, "x int, y int, z int")) is want


# --- settling, chains, sentences ------------------------------------------------
def test_a_mirrored_link_takes_no_place(spark):
    schema = "from_table string, from_column string, to_table string, to_column string, score double, name_similarity double, ratio_overlap double, target_distinct long, origin string"
    rows = [("A", "x", "B", "y", 0.9, 0.9, 1.0, 50, "detected"), ("B", "y", "A", "x", 0.8, 0.9, 1.0, 50, "detected"),
            ("B", "z", "A", "w", 0.7, 0.5, 1.0, 50, "detected"), ("B", "q", "A", "w", 0.6, 0.5, 1.0, 50, "detected"),
            ("A", "k", "B", "y", 0.5, 0.5, 1.0, 50, "declared"), ("C", "a", "D", "b", 0.4, 0.9, 1.0, 50, "detected")]
    found = {(r.from_column, r.to_column): (r.status, r.reason) for r in settle.settle_foreign_keys(
        spark, frame(spark, rows, schema), taken=[("D", "b", "C", "a")]).collect()}
    assert found[("x", "y")][0] == "confirmed" and found[("y", "x")] == ("rejected", "already linked from the other side")
    assert found[("z", "w")][0] == "confirmed" and found[("q", "w")] == ("rejected", "a stronger link joins these tables")
    assert found[("k", "y")][0] == "confirmed" and found[("a", "b")][0] == "rejected"


def test_chains_follow_edges_only():
    assert FD.longest_path({"a": {"b", "c"}, "b": {"a"}, "c": set()}) == ["b", "a", "c"]
    assert FD.longest_path({"a": {"c"}, "c": {"b"}, "b": {"a"}}) == ["a", "c", "b"]
    rng = random.Random(4)
    for _ in range(60):
        names = "abcdefg"[:rng.randint(1, 7)]
        after = {a: {b for b in names if b != a and rng.random() < rng.choice([0.2, 0.5, 1.0])} for a in names}
        paths = [p for n in range(1, len(names) + 1) for p in itertools.permutations(names, n) if all(b in after[a] for a, b in zip(p, p[1:]))]
        got = FD.longest_path(after)
        assert tuple(got) in paths and len(got) == max(map(len, paths))


def test_sentences(spark):
    schema = ("table_name string, column_name string, table_type string, taxonomy_label string, sql_type string, description string, is_primary_key boolean, "
              "is_foreign_key boolean, references_table string, references_column string, null_ratio double, row_count long, sample_values array<string>")
    rows = [("orders", "cust_id", "transaction", "identifier", "TEXT", "who bought. ", False, True, "customers", "id", 0.25, 9, ["7", "8"]),
            ("orders", "id", "unknown", "unknown", "TEXT", PB.UNWRITTEN + "x", True, False, None, None, 0.0, 9, [])]
    first, second = (r.semantic_description for r in PB.metadata_rows(frame(spark, rows, schema), embed=False).orderBy("column_name").collect())
    assert first == ("Column: cust id. Meaning: who bought. Role: points to id of customers. Values: 7 | 8. Empty cells: 25.0 of 100. "
                     "Kind: identifier. Stored as: TEXT. Table: orders, transaction")
    assert second == "Column: id. Role: key of its table. Stored as: TEXT. Table: orders"
    made = frame(spark, [("a", "t", ["1"])], "n string, t string, s array<string>").select(PB.unwritten_description(F.col("n"), F.col("t"), F.col("s")).alias("x"))
    assert made.select("x", PB.is_unwritten(F.col("x")).alias("y")).first() == (PB.UNWRITTEN + "t.a holds 1", True)
    told = PB.table_sentences(frame(spark, [("t", "unknown", 1200, 3, ["id"], [], ["u"], ["net_total"], [f"c{i}" for i in range(9)])],
        "table_name string, table_type string, row_count long, column_count int, primary_key array<string>, references array<string>, "
        "referenced_by array<string>, additive array<string>, others array<string>")).first().description
    assert told == ("Table: t. Amounts: net total. Other columns: c0, c1, c2, c3, c4, c5, c6, c7 and 1 others. Key: id. Pointed to by: u. Size: 1,200 rows by 3")


@pytest.mark.parametrize("few", [200_000, 0])
def test_every_rank_from_a_sketch_and_one_count(spark, monkeypatch, few):
    """Ranks of groups of all sizes, with ties, skew and infinities, finished in the driver or by bins."""
    monkeypatch.setattr(ranks, "FEW", few)
    rnd = random.Random(7)
    groups = {str(n): [rnd.choice([rnd.gauss(0, 1e6), 5.0, float(rnd.randrange(4))]) for _ in range(n)] for n in (1, 2, 3, 7, 12, 40)}
    groups["many"] = [rnd.lognormvariate(0, 6) for _ in range(6000)] + [1.0] * 3000
    groups["ends"] = [-math.inf] * 300 + [rnd.random() for _ in range(500)] + [math.inf] * 300
    long = spark.createDataFrame([(g, x) for g, values in groups.items() for x in values], "group_id string, x double").repartition(6)
    asked = [(g, k) for g, values in groups.items() for k in (range(len(values)) if len(values) <= 40 else {0, 299, 300, 550, 799, 800, len(values) // 2, len(values) - 1})]
    calls, plain = [], ranks._within
    monkeypatch.setattr(ranks, "_within", lambda *a: calls.append(1) or plain(*a))
    got = select_ranks(long, [*asked, ("none", 0)])
    assert got == {(g, k): sorted(groups[g])[k] for g, k in asked}
    assert len(calls) == 1  # no rank was outside its bracket


def test_a_rank_outside_its_bracket_is_found(spark):
    long = spark.createDataFrame([("a", float(i)) for i in range(100)], "group_id string, x double")
    assert select_ranks(long, [("a", 50)], {"a": (100, 0.0, 99.0, [0.0] * (ranks.STEPS + 1))}) == {("a", 50): 50.0}


def test_metric_slices_count_a_record_at_every_cut_it_reaches(spark):
    columns = "arm string, q long, strict boolean, normalised boolean, relaxed boolean, outcome string"
    records = frame(spark, [("a", 1, True, True, True, "answered"), ("a", 2, False, False, False, "answered"), ("a", 3, None, None, True, "no_sql"), ("b", 1, False, None, None, "answered")], columns)
    recalls = frame(spark, [(1, 1.0), (2, 0.6), (9, 0.1)], "q long, recall double")
    changed = frame(spark, [(2,), (2,), (8,)], "q long")
    got = {(r.slice, r.arm, r.changed, r.min_recall): (r.n, r.strict, r.relaxed, r.answered) for r in runs.metric_slices(records, recalls, changed, ["q"], (1.0, 0.5)).collect()}
    assert got == {
        ("all", "a", None, None): (3, 1, 2, 2), ("all", "b", None, None): (1, 0, 0, 1),
        ("changed", "a", True, None): (1, 0, 0, 1), ("changed", "a", False, None): (2, 1, 2, 1), ("changed", "b", False, None): (1, 0, 0, 1),
        ("recall", "a", None, 0.5): (2, 1, 1, 2), ("recall", "a", None, 1.0): (1, 1, 1, 1), ("recall", "b", None, 0.5): (1, 0, 0, 1), ("recall", "b", None, 1.0): (1, 0, 0, 1),
        ("changed, recall", "a", False, 0.5): (1, 1, 1, 1), ("changed, recall", "a", False, 1.0): (1, 1, 1, 1), ("changed, recall", "a", True, 0.5): (1, 0, 0, 1),
        ("changed, recall", "b", False, 0.5): (1, 0, 0, 1), ("changed, recall", "b", False, 1.0): (1, 0, 0, 1)}
    assert runs.metric_slices(records.limit(0), recalls, changed, ["q"]).count() == 0


def test_versions_survive_an_interrupted_write(spark, tmp_path):
    root = str(tmp_path / "layer")
    assert versions.versions(spark, root) == []
    with pytest.raises(ValueError):
        versions.read_version(spark, root)
    layer = lambda i: frame(spark, [(i,)], "v int").coalesce(1)
    assert [versions.publish_version(layer(i), root, keep=3) for i in (1, 2, 3)] == [1, 2, 3]
    torn = versions.stage(layer(99), root)  # the writer died before it named a version
    assert versions.versions(spark, root) == [1, 2, 3] and versions.read_version(spark, root).first().v == 3
    assert versions.publish_version(layer(4), root, keep=3) == 4
    assert versions.versions(spark, root) == [2, 3, 4]
    assert [versions.read_version(spark, root, i).first().v for i in (2, 3, 4)] == [2, 3, 4]
    with pytest.raises(ValueError):
        versions.read_version(spark, root, 1)
    folders = {p.name for p in (tmp_path / "layer" / "data").iterdir() if not p.name.startswith(".")}
    assert torn in folders and len(folders) == 4
    assert versions.drop_versions(spark, root, keep=1, torn_after=-1) == [2, 3]
    assert [p.name for p in (tmp_path / "layer" / "data").iterdir() if not p.name.startswith(".")] != [torn]
    assert versions.read_version(spark, root).first().v == 4
    assert versions.publish_version(layer(5), root) == 5


# --- work that grows with the table ------------------------------------------------
def test_names_are_broadcast_by_their_number_not_by_the_tables_they_come_from(spark):
    from tablesense.operators import retrieve as R

    texts = frame(spark, [(1, "Sum of Net Total, please"), (2, "the NET-total again net total"), (3, "nothing"), (4, None)], "id int, text string")
    # a name's source may be estimated at any size: here a cross product that distinct makes small
    many = spark.range(1 << 20).crossJoin(spark.range(1 << 20).withColumnRenamed("id", "other")).limit(1_000).select(F.lit("net_total").alias("name"))
    names = many.unionAll(frame(spark, [("id",), (None,), ("unused name",)], "name string"))
    found = R.columns_named_in(texts, ["id"], "text", names, "name")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    want = [(1, "net_total"), (2, "net_total")]
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, R.columns_named_in(texts, ["id"], "text", names, "name", few=0).collect())) == want


def test_one_task_sums_the_grams_of_a_bounded_number_of_rows(spark, monkeypatch):
    from tablesense.functions import vectors

    rows = frame(spark, [(i % 50, f"name {i % 7} of {i}") for i in range(400)], "id int, text string").coalesce(1)
    want = sorted(map(tuple, vectors.trigram_weights(rows, ["id"], "text").collect()))
    monkeypatch.setattr(vectors, "PIECE", 20)
    dealt = vectors.trigram_weights(rows, ["id"], "text")
    assert sorted(map(tuple, dealt.collect())) == want
    assert "RoundRobinPartitioning(20)" in dealt._jdf.queryExecution().optimizedPlan().toString() or "RepartitionByExpression" in dealt._jdf.queryExecution().optimizedPlan().toString() or "Repartition 20" in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_shares_of_a_table_are_cut_before_it_is_shuffled(spark, tmp_path, monkeypatch):
    from tablesense.operators import keys as K

    made = spark.range(200_000).selectExpr("xxhash64(id div 4) as a", "cast(id % 4 as int) as b", "cast(id % 3 as int) as c", "concat('x', id % 5) as d")
    made.coalesce(1).write.parquet(f"{tmp_path}/one")
    df, shuffled = spark.read.parquet(f"{tmp_path}/one"), []
    whole = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: shuffled.append(a) or whole(self, *a))
    found = K.composite_keys(df, {"a": 50_000, "b": 4, "c": 3, "d": 5}, 200_000, 2, sample_rows=100)
    # of four rows in a row, no two agree on id % 5 or id % 4; the first and the last agree on id % 3
    assert sorted(sorted(x) for x in found) == [["a", "b"], ["a", "d"]] and not shuffled


def test_a_full_count_of_dependencies_deals_a_bounded_number_of_rows_to_a_task(spark, monkeypatch):
    from tablesense.operators import dependencies as FD

    df = frame(spark, [(i % 40, i % 40 % 8, i) for i in range(800)], "a int, b int, n int").coalesce(1)
    want = sorted(map(tuple, FD.dependencies(spark, {"t": df}).collect()))
    seen, deal = [], FD.in_pieces
    monkeypatch.setattr(FD, "PIECE", 50)
    monkeypatch.setattr(FD, "in_pieces", lambda *a: seen.append(deal(*a)) or seen[-1])
    assert sorted(map(tuple, FD.dependencies(spark, {"t": df}).collect())) == want and want
    assert [x.rdd.getNumPartitions() for x in seen] == [16]


def test_values_are_counted_as_stored_and_written_as_before(spark):
    import datetime as dt
    from decimal import Decimal

    from tablesense.operators import value_counts as VC

    rows = [(0.0, 1, "1", dt.datetime(2024, 1, 2, 3, 4, 5, 600), dt.date(2024, 1, 2), True, Decimal("1.50")),
            (-0.0, 1, " 1", dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2), False, Decimal("2.00")),
            (1e15, None, "", None, None, None, None), (float("nan"), 7, None, None, None, True, None), (float("inf"), 1, "é", None, None, None, Decimal("1.50"))]
    tables = {"t": frame(spark, rows, "f double, i int, s string, at timestamp, d date, b boolean, m decimal(9,2)")}
    refs = VC.column_refs(tables)
    plain = VC.long_cells(tables["t"], refs).groupBy("cid", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = VC.value_counts(tables, refs)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect()))
    assert "bigint" in counted._jdf.queryExecution().analyzed().toString() and counted.where("cid = 0 AND value = '0'").first().n == 2


def test_a_profile_counts_values_once(spark, monkeypatch):
    from tablesense.operators import profile as P, ranks as R, value_counts as VC
    from tablesense.operators.column_types import column_types

    rows = [(float(i * i % 97) / 4, i % 5, f"w{i % 3}") for i in range(500)] + [(float("nan"), None, None)]
    tables = {"t": frame(spark, rows, "x double, k int, w string")}
    counts = VC.value_counts(tables).cache()
    monkeypatch.setattr(P, "value_counts", lambda *a: pytest.fail("counted again"))
    types = column_types(spark, tables, counts=counts).select("cid", "column_type")
    got = {r.column_name: r.distribution for r in P.profile(spark, tables, types, counts).collect()}
    xs = sorted(float(i * i % 97) / 4 for i in range(500))
    assert f'"median":{(xs[249] + xs[250]) / 2}' in got["x"]
    values = counts.where("cid < 2").select(F.col("cid").alias("span"), F.col("value").cast("double").alias("x"), "n")
    want = R.medians_of_counts(values, {0: 500, 1: 500})
    monkeypatch.setattr(R, "FEW", 2)
    assert R.medians_of_counts(values, {0: 500, 1: 500}) == want == {0: (xs[249] + xs[250]) / 2, 1: 2.0}

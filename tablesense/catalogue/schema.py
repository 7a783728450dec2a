"""Column names of the given tables, used to spell oracle SQL, and SQL fragments."""

#: table -> ((column, kind), …); kind is int, float, text, time or array.
GIVEN = {
    "region": (("r_regionkey", "int"), ("r_name", "text")),
    "nation": (("n_nationkey", "int"), ("n_name", "text"), ("n_regionkey", "int")),
    "customer": (("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "float"),
                 ("c_mktsegment", "text")),
    "supplier": (("s_suppkey", "int"), ("s_name", "text"), ("s_nationkey", "int"), ("s_acctbal", "float")),
    "part": (("p_partkey", "int"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"),
             ("p_size", "int"), ("p_retailprice", "float")),
    "orders": (("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "float"),
               ("o_orderdate", "time"), ("o_orderpriority", "text")),
    "lineitem": (("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"),
                 ("l_tax", "float"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")),
    "events": (("event_id", "int"), ("ts", "time"), ("user_id", "int"), ("event_type", "text"),
               ("value", "float"), ("props", "text")),
    "documents": (("doc_id", "int"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "int")),
    "embeddings": (("vec_id", "int"), ("embedding", "array"), ("label", "int")),
    "pages": (("page_id", "int"), ("url", "text"), ("html", "text")),
    "benchmark": (("item_id", "int"), ("text", "text")),
    "labels": (("doc_id", "int"), ("quality", "int"), ("toxic", "int")),
    "conversations": (("conv_id", "int"), ("turn", "int"), ("role", "text"), ("text", "text")),
}
TPC = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def columns(tables=None, kinds=("int", "float", "text", "time")):
    """(table, column, kind) of the given tables, in order."""
    return [(t, c, k) for t in (tables or GIVEN) for c, k in GIVEN[t] if k in kinds]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


#: Characters ``str.strip`` removes, as a DuckDB string expression.
STRIP_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def strip(expr: str) -> str:
    return f"trim({expr}, {STRIP_CHARS})"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def trigram_cosine(a: str, b: str, dim: int = 384) -> str:
    """Cosine of the hashed gram counts of two texts, as a DuckDB expression."""
    return (
        f"(SELECT CASE WHEN sum(x * x) > 0 AND sum(y * y) > 0 THEN "
        f"sum(x * y) / (sqrt(sum(x * x)::DOUBLE * sum(y * y)::DOUBLE)) ELSE 0.0 END FROM ("
        f"SELECT bucket, sum(CASE WHEN side = 1 THEN sgn ELSE 0 END)::BIGINT AS x, "
        f"sum(CASE WHEN side = 2 THEN sgn ELSE 0 END)::BIGINT AS y FROM ("
        f"SELECT 1 AS side, {bucket('g', dim)} AS bucket, {sign('g')} AS sgn FROM (SELECT unnest({grams(a)}) AS g) "
        f"UNION ALL SELECT 2, {bucket('g', dim)}, {sign('g')} FROM (SELECT unnest({grams(b)}) AS g)) GROUP BY bucket))"
    )


def grams(text: str) -> str:
    padded = f"('  ' || {strip(f'lower({text})')} || '  ')"
    return (
        f"list_concat([substring({padded}, i::INT, 3) for i in range(1, length({padded}) - 1)], "
        f"['__' || w || '__' for w in string_split_regex(lower({text}), '\\s+') if w <> ''])"
    )


def bucket(gram: str, dim: int) -> str:
    return f"(('0x' || substring(md5({gram}), 1, 8))::BIGINT % {dim})"


def sign(gram: str) -> str:
    return f"(CASE WHEN ('0x' || substring(md5({gram}), 9, 2))::BIGINT % 2 = 1 THEN -1 ELSE 1 END)"


def humanise(name: str) -> str:
    return (
        f"lower(trim(regexp_replace(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
        f"'[^0-9a-zA-Z]+', ' ', 'g')))"
    )


def expand(text: str) -> str:
    from tablesense import values as V

    keys = "[" + ", ".join(quote(k) for k in V.ABBREVIATIONS) + "]"
    vals = "[" + ", ".join(quote(v) for v in V.ABBREVIATIONS.values()) + "]"
    return (
        f"array_to_string([coalesce({vals}[list_position({keys}, t)], t) for t in string_split({text}, ' ')], ' ')"
    )


def normal_name(name: str) -> str:
    return expand(humanise(name))

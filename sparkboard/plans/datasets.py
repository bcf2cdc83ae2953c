"""Sources, the dataset store and column profiles on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkboard.functions import documents
from sparkboard.functions.naming import dataset_name, normalize_names
from sparkboard.functions.values import json_field, nan_to_null, typed
from sparkboard.operators.profile import (
    DISTINCT_ERROR,
    cast_by_profile,
    distinct_ratio,
    merged_parts,
    profile,
    profile_of_parts,
    profile_parts,
    type_lookup,
)
from sparkboard.plans.common import Query, money, on, plain, table, total_sql
from sparkboard.sources.csv import read_csv, with_row_number
from sparkboard.sources.scratch import materialize, new_path
from sparkboard.sources.store import (
    Catalog,
    dataset_record,
    latest_per_session,
    read_dataset,
    rows_as_json,
    upload_csv,
    write_dataset,
)

RAW_CUSTOMER_NAMES = ("CustomerID", "Customer Name", "NationKey", "Acct. Balance ($)", "Customer_Name")


def _as_csv(df: DataFrame, name: str) -> str:
    """Write a table as CSV with a header to the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


def csv_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written with untidy headers and read back as numbered rows of text."""
    raw = table(spark, folder, "customer").toDF(*RAW_CUSTOMER_NAMES)
    return read_csv(spark, _as_csv(raw, "customer-csv"), row_number=True)


def csv_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts, with line breaks and quotes in them, through a CSV file."""
    documents = table(spark, folder, "documents")
    return read_csv(spark, _as_csv(documents, "documents-csv"))


def uploaded_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as an uploaded file: types found, rows stored, totals per group of what came back."""
    orders = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    path = _as_csv(orders.toDF(*[c.removeprefix("o_").title() for c in orders.columns]), "orders-csv")
    upload = upload_csv(spark, path, new_path(spark, "store"), "orders", "My Orders.2024.csv")
    sums = upload.rows.groupBy("orderstatus", "orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("totalprice").alias("total"),
        F.min("orderdate").cast("date").alias("first_date"),
        F.max("row_number").alias("last_row"),
    )
    record = upload.record.select("dataset_name", "row_count", "column_count", _columns_text())
    return plain(sums.withColumn("r", record.select(F.struct("*").alias("r")).scalar()).select(
        "*", "r.*"
    ).drop("r"))


def _columns_text():
    return F.array_join(
        F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"])), ","
    ).alias("columns")


def stored_lineitems(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written under three dataset ids, each read back alone."""
    rows = table(spark, folder, "lineitem")
    path = new_path(spark, "lineitem-store")
    write_dataset(rows, path, F.col("l_returnflag"))
    parts = [
        read_dataset(spark, path, flag).agg(
            F.lit(flag).alias("dataset_id"),
            F.count(F.lit(1)).alias("n"),
            F.sum("l_linenumber").alias("lines"),
        )
        for flag in ("A", "N", "R")
    ]
    return reduce(DataFrame.unionAll, parts)


# Table -> text columns; the other columns are typed.
CATALOG = {
    "customer": "c_custkey c_name* c_nationkey c_acctbal c_mktsegment*",
    "part": "p_partkey p_name* p_brand* p_type* p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate@ o_orderpriority*",
    "documents": "doc_id text* lang* source* n_chars",
    "conversations": "conv_id turn role* text*",
    "events": "event_id ts@ user_id event_type* value props*",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag* l_linestatus* l_shipdate@",
    "supplier": "s_suppkey s_name* s_nationkey s_acctbal",
    "nation": "n_nationkey n_name* n_regionkey",
    "region": "r_regionkey r_name*",
    "pages": "page_id url* html*",
    "benchmark": "item_id text*",
    "labels": "doc_id quality toxic",
}


def catalog(spark: SparkSession, folder: str) -> Catalog:
    """A stored catalog with one record per table, from its profile; every record is added twice, as by a retry."""
    found = Catalog(spark, new_path(spark, "catalog"), buckets=16)
    records = [dataset_record(spark, profile(table(spark, folder, t)), f"My {t}.v1.CSV", t) for t in CATALOG]
    together = materialize(reduce(DataFrame.unionAll, records), "all-records")
    for _ in range(2):
        found.add(together, "first")
    return found


def catalog_records(spark: SparkSession, folder: str) -> DataFrame:
    return catalog(spark, folder).records().select(
        "dataset_id", "dataset_name", "row_count", "column_count", _columns_text()
    )


def dataset_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One record of the whole catalog, by its dataset and by its session; one bucket is opened for each."""
    found = catalog(spark, folder)
    found.compact()
    parts = [found.dataset("documents").withColumn("by", F.lit("dataset")), found.session("lineitem").withColumn("by", F.lit("session"))]
    return reduce(DataFrame.unionByName, parts).select("by", "dataset_id", "row_count", "column_count")


def _type_sql(name: str) -> str:
    column = name.rstrip("*@")
    if name.endswith("@"):
        return f"'{column}:datetime'"
    if not name.endswith("*"):
        return f"'{column}:numeric'"
    return (
        f"'{column}:' || CASE WHEN COUNT({column}) > 0 AND "
        f"COUNT(DISTINCT {column}) < 0.5 * COUNT({column}) THEN 'categorical' ELSE 'text' END"
    )


CATALOG_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS dataset_id, 'my_{t}.v1' AS dataset_name, COUNT(*) AS row_count,
        {len(names.split())} AS column_count,
        {" || ',' || ".join(_type_sql(n) for n in names.split())} AS columns FROM {t}"""
    for t, names in CATALOG.items()
)


def profiled(name: str):
    """The profile of a table as its schema gives it."""
    return on(name, lambda df: profile(df).select(
        "ordinal", "name", "type", "row_count", "non_null", "distinct_count", "distinct_ratio"
    ))


def profile_sql(name: str) -> str:
    selects = []
    for i, spelled in enumerate(CATALOG[name].split()):
        c = spelled.rstrip("*@")
        if spelled.endswith("*"):
            counts = (
                f"COUNT({c}) AS non_null, COUNT(DISTINCT {c}) AS distinct_count, "
                f"CAST(COUNT(DISTINCT {c}) AS DOUBLE) / COUNT({c}) AS distinct_ratio"
            )
            kind = f"CASE WHEN COUNT(DISTINCT {c}) < 0.5 * COUNT({c}) THEN 'categorical' ELSE 'text' END"
        else:
            counts = (
                "CAST(NULL AS BIGINT) AS non_null, CAST(NULL AS BIGINT) AS distinct_count, "
                "CAST(NULL AS DOUBLE) AS distinct_ratio"
            )
            kind = "'datetime'" if spelled.endswith("@") else "'numeric'"
        selects.append(
            f"SELECT {i} AS ordinal, '{c}' AS name, {kind} AS type, COUNT(*) AS row_count, {counts} FROM {name}"
        )
    return " UNION ALL ".join(selects)


TEXT_LINEITEM = (
    "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
    "l_shipdate", "l_shipped", "l_note",
)


def profiled_text(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as text in every column: types must be found again from all values."""
    rows = table(spark, folder, "lineitem")
    shipped = F.date_format("l_shipdate", "dd/MM/yyyy")
    text = rows.withColumn("l_shipped", shipped).withColumn(
        "l_note", F.concat_ws(" ", "l_orderkey", "l_linenumber", "l_shipped")
    ).select(*[F.col(c).cast("string").alias(c) for c in TEXT_LINEITEM])
    return profile(text).select("name", "type", "target", "spelling", "non_null", "distinct_count")


def _text_profile_sql() -> str:
    # What each column is, with the counts only undecided ones need.
    kinds = {
        "l_orderkey": ("numeric", "bigint", None),
        "l_quantity": ("numeric", "'decimal(3,1)'", None),
        "l_extendedprice": ("numeric", None, None),
        "l_discount": ("numeric", None, None),
        "l_shipdate": ("datetime", "timestamp_ntz", "iso"),
        "l_shipped": ("datetime", "timestamp_ntz", "d/m/y"),
    }
    selects = []
    for c in TEXT_LINEITEM:
        source = {
            "l_shipped": "strftime(l_shipdate, '%d/%m/%Y')",
            "l_note": "l_orderkey || ' ' || l_linenumber || ' ' || strftime(l_shipdate, '%d/%m/%Y')",
        }.get(c, c)
        if c in ("l_quantity", "l_extendedprice", "l_discount"):
            # Digits before the point and after it.
            whole = f"MAX(length(split_part(CAST({c} AS VARCHAR), '.', 1)))"
            places = f"MAX(length(split_part(CAST({c} AS VARCHAR), '.', 2)))"
            target = f"'decimal(' || ({whole} + {places}) || ',' || {places} || ')'"
            row = f"'numeric' AS type, {target} AS target, CAST(NULL AS VARCHAR) AS spelling"
        elif c in kinds:
            kind, target, spelling = kinds[c]
            shown = f"'{spelling}'" if spelling else "CAST(NULL AS VARCHAR)"
            row = f"'{kind}' AS type, '{target}' AS target, {shown} AS spelling"
        else:
            row = (
                f"CASE WHEN COUNT(DISTINCT {source}) < 0.5 * COUNT({source}) THEN 'categorical' "
                "ELSE 'text' END AS type, 'string' AS target, CAST(NULL AS VARCHAR) AS spelling"
            )
        unique = f"COUNT(DISTINCT {source})" if c not in kinds else "CAST(NULL AS BIGINT)"
        selects.append(
            f"SELECT '{c}' AS name, {row}, COUNT({source}) AS non_null, {unique} AS distinct_count FROM lineitem"
        )
    return " UNION ALL ".join(selects)


def retyped_lineitems(spark: SparkSession, folder: str) -> DataFrame:
    """Text in, typed rows out, all columns: sums over what the profile found to be numbers."""
    rows = table(spark, folder, "lineitem")
    shipped = F.date_format("l_shipdate", "dd/MM/yyyy").alias("l_shipped")
    reduced = F.when(F.col("l_discount") > 0.05, "True").otherwise("false").alias("l_reduced")
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns if c != "l_shipdate"], shipped, reduced)
    found = nan_to_null(cast_by_profile(text, profile(text)))
    sums = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return plain(found.groupBy("l_shipped", "l_returnflag", "l_linestatus").agg(
        *[F.sum(c).alias(c.removeprefix("l_")) for c in sums], F.count_if("l_reduced").alias("reduced"),
    ))


# The fields of a line item's document, and the types they are read as.
LINE_FIELDS = {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def line_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as JSON rows, stored as variants, and all their fields read back with types."""
    rows = rows_as_json(table(spark, folder, "lineitem"))
    stored = materialize(rows.withColumn("data", documents.document(F.col("data"))), "line-documents")
    return plain(documents.fields(stored, "data", LINE_FIELDS))


def event_fields(events: DataFrame) -> DataFrame:
    """One field of an event's document as several types, and one which is not there."""
    parsed = events.withColumn("props", documents.document(F.col("props")))
    kinds = {"k_text": "string", "k_whole": "bigint", "k_exact": "decimal(18,2)", "k_double": "double"}
    read = [documents.field(F.col("props"), "k", kind).alias(name) for name, kind in kinds.items()]
    return parsed.select("event_id", *read, documents.field(F.col("props"), "missing", "bigint").alias("missing"))


# Raw names as people write headers, from the values of several tables.
RAW_NAMES = (
    ("part", "concat(p_name, ' ', p_brand, ' ID')"),
    ("part", "concat(p_type, 'ItemID(', cast(p_size as string), ')')"),
    ("customer", "concat('  ', c_name, '__Total ($) ', c_mktsegment)"),
    ("supplier", "s_name"),
    ("documents", "text"),
    ("pages", "url"),
)


def raw_names(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select(F.expr(e).alias("name")) for t, e in RAW_NAMES]
    return reduce(DataFrame.unionAll, parts)


def clean_names(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_names(raw_names(spark, folder)).groupBy("normalized").agg(
        F.count(F.lit(1)).alias("n")
    )


CLEAN_NAMES_SQL = f"""
    WITH raw AS ({" UNION ALL ".join(f"SELECT {e} AS name FROM {t}" for t, e in RAW_NAMES)}),
    plain AS (
        SELECT replace(regexp_replace(
            regexp_replace(name, 'ID($|[^\\p{{L}}\\p{{N}}_])', 'Id\\1', 'g'),
            '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), ' ', '_') AS s FROM raw
    )
    SELECT trim(regexp_replace(lower(
            substr(s, 1, 1) || regexp_replace(substr(s, 2), '([A-Z])', '_\\1', 'g')), '_+', '_', 'g'),
        '_') AS normalized, COUNT(*) AS n
    FROM plain GROUP BY 1
"""


def document_names(spark: SparkSession, folder: str) -> DataFrame:
    """Dataset names for the pages, as if each URL path were an uploaded file."""
    return table(spark, folder, "pages").select(
        "page_id", dataset_name(F.concat(F.col("url"), F.lit(" Copy.CSV"))).alias("dataset_name")
    )


def schema_types(spark: SparkSession, folder: str) -> DataFrame:
    """The type of the column each part's label would name in its own table."""
    parts = table(spark, folder, "part")
    names = parts.select("p_partkey", F.concat(F.lit("p_"), F.lower("p_type")).alias("name")).unionAll(
        parts.select("p_partkey", F.element_at(
            F.array(*[F.lit(c) for c in parts.columns]),
            (F.col("p_size") % len(parts.columns) + 1).cast("int"),
        ))
    )
    return type_lookup(names, profile(parts)).groupBy("name", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys")
    )


PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
SCHEMA_TYPES_SQL = f"""
    WITH names AS (
        SELECT p_partkey, 'p_' || lower(p_type) AS name FROM part
        UNION ALL
        SELECT p_partkey, CASE p_size % 6 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(PART_COLUMNS))}
            END FROM part
    )
    SELECT name, CASE WHEN name IN ('p_partkey', 'p_size', 'p_retailprice') THEN 'numeric'
            WHEN name IN ('p_name', 'p_brand', 'p_type') THEN 'categorical' ELSE 'unknown' END AS type,
        COUNT(*) AS n, CAST(SUM(p_partkey) AS BIGINT) AS keys
    FROM names GROUP BY 1, 2
"""

def merged_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' profile merged from parts by source, and whether its distinct counts keep their error."""
    documents = table(spark, folder, "documents")
    early = F.coalesce(F.col("source") < "src15", F.lit(False))
    parts = reduce(DataFrame.unionByName, [materialize(profile_parts(documents.where(c)), "parts") for c in (early, ~early)])
    found = profile_of_parts(merged_parts(parts))
    texts = ("text", "lang", "source")
    exact = documents.agg(*[F.count_distinct(c).alias(c) for c in texts]).unpivot([], list(texts), "name", "exact")
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= DISTINCT_ERROR * F.col("exact")
    return found.join(exact, "name", "left").select("name", "type", "row_count", "non_null", near.alias("within_error"))


MERGED_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, CASE WHEN COUNT({c}) > 0 AND COUNT(DISTINCT {c}) < 0.5 * COUNT({c}) THEN 'categorical' ELSE 'text' END AS type,
        COUNT(*) AS row_count, COUNT({c}) AS non_null, true AS within_error FROM documents"""
    for c in ("text", "lang", "source")
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, 'numeric' AS type, COUNT(*) AS row_count, CAST(NULL AS BIGINT) AS non_null, CAST(NULL AS BOOLEAN) AS within_error FROM documents"
    for c in ("doc_id", "n_chars")
)


QUERIES = {
    "merged_profile": Query("P1 P2 P3", merged_profile, MERGED_PROFILE_SQL),
    "csv_customers": Query(
        "E1 E2 E3 E4", csv_customers,
        """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
               CAST(c_nationkey AS VARCHAR) AS nation_key, CAST(c_acctbal AS VARCHAR) AS acct_balance,
               c_mktsegment AS customer_name_1, row_number() OVER (ORDER BY c_custkey) AS row_number
           FROM customer""",
    ),
    "csv_documents": Query(
        "E1", csv_documents, """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
           FROM documents"""
    ),
    "uploaded_orders": Query(
        "E1 E2 E4 E7 E8 E9 E10 P1 P2", uploaded_orders,
        f"""SELECT o_orderstatus AS orderstatus, o_orderpriority AS orderpriority, COUNT(*) AS n,
                CAST(SUM({money('o_totalprice')}) AS DOUBLE) AS total,
                CAST(CAST(MIN(o_orderdate) AS DATE) AS VARCHAR) AS first_date,
                MAX(o_orderkey) + 1 AS last_row, 'my_orders.2024' AS dataset_name,
                (SELECT COUNT(*) FROM orders) AS row_count, 6 AS column_count,
                'orderkey:numeric,custkey:numeric,orderstatus:categorical,totalprice:numeric,'
                || 'orderdate:datetime,orderpriority:categorical' AS columns
            FROM orders GROUP BY 1, 2""",
    ),
    "clean_names": Query("E2", clean_names, CLEAN_NAMES_SQL),
    "file_names": Query(
        "E9", document_names,
        """SELECT page_id, lower(replace(url, ' ', '_')) || '_copy' AS dataset_name FROM pages""",
    ),
    "row_numbers": Query(
        "E4", on("orders", lambda o: with_row_number(o).select("row_number", "o_orderkey")),
        "SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, o_orderkey FROM orders",
    ),
    "row_documents": Query(
        "E5 E12", on("customer", lambda c: rows_as_json(nan_to_null(c))),
        """SELECT CAST(json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_nationkey', c_nationkey,
               'c_acctbal', c_acctbal, 'c_mktsegment', c_mktsegment) AS VARCHAR) AS data FROM customer""",
    ),
    "json_fields": Query(
        "E6 E7", on("events", lambda e: e.select(
            "event_id", json_field(F.col("props"), "k").alias("k"),
            json_field(F.col("props"), "missing").alias("missing"))),
        """SELECT event_id, json_extract_string(props, '$.k') AS k,
               json_extract_string(props, '$.missing') AS missing FROM events""",
    ),
    "line_documents": Query(
        "E5 E6 E7", line_documents,
        f"""SELECT {", ".join(c for c in LINE_FIELDS if c != "l_shipdate")}, CAST(l_shipdate AS VARCHAR) AS l_shipdate
            FROM lineitem""",
    ),
    "event_fields": Query(
        "E6 E7", on("events", event_fields),
        """SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_whole,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_exact, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_double,
               CAST(json_extract_string(props, '$.missing') AS BIGINT) AS missing FROM events""",
    ),
    "totals_of_json_field": Query(
        "E6 E7", on("events", lambda e: e.groupBy("event_type").agg(
            F.sum(typed(json_field(F.col("props"), "k"), "numeric")).alias("k"))),
        """SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS DECIMAL(18,2)))
               AS DOUBLE) AS k FROM events GROUP BY event_type""",
    ),
    "typed_texts": Query(
        "E7", on("part", lambda p: p.select(
            "p_partkey",
            typed(F.replace("p_brand", F.lit("Brand#"), F.lit("")), "numeric").alias("brand"),
            typed(F.col("p_name"), "numeric", "null").alias("name_as_number"),
            typed(F.concat(F.lit("2024-01-"), F.col("p_size")), "datetime", "null").alias("day"))),
        """SELECT p_partkey, CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand,
               TRY_CAST(p_name AS DOUBLE) AS name_as_number,
               CASE WHEN p_size BETWEEN 1 AND 31
                   THEN '2024-01-' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS day
           FROM part""",
    ),
    "stored_lineitems": Query(
        "E8 E10", stored_lineitems,
        """SELECT l_returnflag AS dataset_id, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines
           FROM lineitem GROUP BY 1""",
    ),
    "catalog_records": Query("E9 P1 P2", catalog_records, CATALOG_SQL),
    "dataset_lookup": Query(
        "E9 E10 E11 P2", dataset_lookup,
        """SELECT 'dataset' AS by, 'documents' AS dataset_id, COUNT(*) AS row_count, 5 AS column_count FROM documents
           UNION ALL SELECT 'session', 'lineitem', COUNT(*), 11 FROM lineitem""",
    ),
    "latest_order_per_customer": Query(
        "E11", on("orders", lambda o: latest_per_session(o, "o_custkey", "o_orderdate", "o_orderkey").select(
            "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")),
        """SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM (
               SELECT *, row_number() OVER (PARTITION BY o_custkey
                   ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) AS ranked
           WHERE place = 1""",
    ),
    **{
        f"profile_{t}": Query("P1 P2 P3", profiled(t), profile_sql(t))
        for t in ("customer", "part", "documents", "conversations", "events")
    },
    "profile_text_lineitems": Query("P1", profiled_text, _text_profile_sql()),
    "retyped_lineitems": Query(
        "E7 E12 P1", retyped_lineitems,
        f"""SELECT CAST(l_shipdate AS VARCHAR) AS l_shipped, l_returnflag, l_linestatus, {", ".join(
                f"CAST(SUM({c}) AS BIGINT) AS {c.removeprefix('l_')}"
                for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))}, SUM(l_quantity) AS quantity, {", ".join(
                f"{total_sql(c)} AS {c.removeprefix('l_')}" for c in ("l_extendedprice", "l_discount", "l_tax"))},
                CAST(COUNT(CASE WHEN l_discount > 0.05 THEN 1 END) AS BIGINT) AS reduced
            FROM lineitem GROUP BY l_shipdate, l_returnflag, l_linestatus""",
    ),
    "distinct_ratio": Query(
        "P3", on("lineitem", lambda li: distinct_ratio(li, "l_extendedprice")),
        """SELECT COUNT(DISTINCT l_extendedprice) AS distinct_count, COUNT(l_extendedprice) AS non_null,
               CAST(COUNT(DISTINCT l_extendedprice) AS DOUBLE) / COUNT(l_extendedprice) AS distinct_ratio
           FROM lineitem""",
    ),
    "schema_types": Query("P4", schema_types, SCHEMA_TYPES_SQL),
}

"""Queries: struct/list flattening, cell sanitizing, markdown table lines,
row index, table profiles, CSV dialect sniffing and format round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tabular as TB
from ..operators.store import write_staged
from ..session import scratch_path
from ..sources import formats as FM
from ..functions.sniff import csv_dialect
from .registry import register
from .tables import read

WS = TB.WS_TAB


def _nested_customers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(
        "c_custkey",
        F.struct("c_name", F.struct("n_name", F.struct("r_name").alias("region")).alias("nation")).alias("c"),
        F.array("c_mktsegment", F.lower("c_mktsegment")).alias("tags"),
        F.array(F.col("c_custkey") % 7, F.col("c_nationkey").cast("bigint")).alias("ks"),
        F.array(*[F.col("c_custkey") + i for i in range(5)]).alias("long"),
        "c_acctbal")


def _sql_clean(x):
    return (f"regexp_replace(replace(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '[{WS}]+', ' ', 'g'), '|', '¦'),"
            f" '^[{WS}]+|[{WS}]+$', '', 'g')")


@register("tab_1_flatten", f"""
SELECT row_number() OVER (ORDER BY c.c_custkey) AS "RowID", c.c_custkey,
  c.c_mktsegment || ', ' || lower(c.c_mktsegment) AS tags,
  CAST(c.c_custkey % 7 AS VARCHAR) || ', ' || CAST(c.c_nationkey AS VARCHAR) AS ks,
  c.c_acctbal, c.c_name AS "c.c_name", n.n_name AS "c.nation.n_name", r.r_name AS "c.nation.region.r_name"
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def tab_1_flatten(spark, sf_dir):
    """Flatten nested structs to dotted columns (appended at the end), join
    short lists with ', ', drop the numeric list longer than 4, add RowID."""
    flat = TB.flatten(_nested_customers(spark, sf_dir))
    return TB.row_index(flat, ["c_custkey"])


def _lines_sql(tbl, key, cols):
    cells = " || ' | ' || ".join(_sql_clean(c) for c in ["rn"] + cols)
    header = " | ".join(["RowID"] + cols)
    sep = " | ".join("-" for _ in ["RowID"] + cols)
    return f"""
SELECT 0::BIGINT AS line_no, '{header}' AS line UNION ALL SELECT 1, '{sep}'
UNION ALL SELECT rn + 1, {cells} FROM (SELECT row_number() OVER (ORDER BY {key}) AS rn, * FROM {tbl})"""


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("tab_4_render", _lines_sql("orders", "o_orderkey", ORDER_COLS))
def tab_4_render(spark, sf_dir):
    """Markdown table of ``orders`` as lines: header, separator, one sanitized
    row per line in key order (cells: null → '', whitespace runs → ' ', '|' → '¦')."""
    t = TB.to_table(read(spark, sf_dir, "orders"), ["o_orderkey"])
    return TB.markdown_lines(t)


@register("tab_3_cells", f"""
SELECT c_custkey, {_sql_clean("c_name || ' |' || chr(10) || ' ' || c_mktsegment || '  '")} AS cell,
       {_sql_clean("CASE WHEN c_acctbal > 0 THEN c_acctbal END")} AS bal
FROM customer""")
def tab_3_cells(spark, sf_dir):
    """Cell sanitizing on text with pipes, newlines and padding, and on nulls."""
    c = read(spark, sf_dir, "customer")
    raw = F.concat("c_name", F.lit(" |\n "), "c_mktsegment", F.lit("  "))
    return c.select("c_custkey", TB.sanitize(raw).alias("cell"),
                    TB.sanitize(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("bal"))


@register("win_3_rowid", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS "RowID", l_orderkey, l_linenumber FROM lineitem""")
def win_3_rowid(spark, sf_dir):
    """RowID 1..n over lineitem in key order (range sort + partition offsets)."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return TB.row_index(li, ["l_orderkey", "l_linenumber"])


@register("win_3_file_order", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS "RowID", l_orderkey, l_linenumber FROM lineitem""")
def win_3_file_order(spark, sf_dir):
    """RowID in file order: lineitem keys written in order to CSV files of many
    splits, numbered as they lie in the files."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    path = scratch_path(spark, "ordered-csv")
    li.repartitionByRange(4, "l_orderkey", "l_linenumber").sortWithinPartitions("l_orderkey", "l_linenumber").write.csv(path)
    return TB.file_row_index(spark.read.schema(li.schema).csv(path))


@register("tab_4_chunks", "WITH t AS (" + _lines_sql("orders", "o_orderkey", ORDER_COLS) + """),
h AS (SELECT string_agg(line, chr(10) ORDER BY line_no) AS head FROM t WHERE line_no < 2),
r AS (SELECT line_no, line, coalesce(sum(length(line) + 1) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t WHERE line_no >= 2),
c AS (SELECT CAST(floor(pos / (4000 - length(head) - 1)) AS BIGINT) AS k, head || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS markdown FROM r, h GROUP BY 1, head)
SELECT row_number() OVER (ORDER BY k) - 1 AS idx, sha256(markdown) AS sha256, CAST(length(markdown) AS BIGINT) AS n_chars FROM c""")
def tab_4_chunks(spark, sf_dir):
    """The markdown table of ``orders`` as chunks of whole rows under its header,
    cut by distributed prefix sums of the line lengths."""
    lines = TB.markdown_lines(TB.to_table(read(spark, sf_dir, "orders"), ["o_orderkey"]))
    out = TB.table_chunks(write_staged(lines, "table-lines"), 4000)
    return out.select("idx", F.sha2("markdown", 256).alias("sha256"), F.length("markdown").cast("bigint").alias("n_chars"))


PROFILE_COLS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "embeddings": ["vec_id", "label"],
    "labels": ["doc_id", "quality", "toxic"],
    "benchmark": ["item_id", "text"],
}


@register("agg_5_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, count(*) AS num_rows, {len(c) + 1}::BIGINT AS num_cols, "
    f"'{', '.join(['RowID'] + c)}' AS columns FROM {t}" for t, c in PROFILE_COLS.items()))
def agg_5_profile(spark, sf_dir):
    """Table profile after flattening (with RowID): rows, columns and names;
    the 64-wide embedding list is dropped by the list-length rule."""
    parts = []
    for t in PROFILE_COLS:
        flat = TB.flatten(read(spark, sf_dir, t))
        cols = ["RowID"] + flat.columns
        parts.append(flat.agg(F.count(F.lit(1)).alias("num_rows")).select(
            F.lit(t).alias("tbl"), "num_rows", F.lit(len(cols)).cast("bigint").alias("num_cols"),
            F.lit(", ".join(cols)).alias("columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("agg_9_list_drop", """
SELECT 'embeddings' AS tbl, max(len(embedding)) AS max_len, max(len(embedding)) > 4 AS dropped FROM embeddings""")
def agg_9_list_drop(spark, sf_dir):
    """List-column drop test: longest numeric list over the column > 4."""
    e = read(spark, sf_dir, "embeddings")
    m = TB.list_lengths(e)["embedding"]
    return e.agg(F.max(F.size("embedding")).cast("bigint").alias("max_len")).select(
        F.lit("embeddings").alias("tbl"), "max_len", (F.col("max_len") > TB.MAX_LIST_LEN).alias("dropped")) \
        if m is not None else None


DIALECTS = [(";", "", "", True), ("|", "", "", False), ("\t", "", "", True), (",", "", "", False),
            (",", '"', "", True), (";", "'", "", False), (",", '"', "\\", False), ("|", "'", "\\", True)]


@register("agg_7_dialect", """
WITH n AS (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1),
v AS (SELECT * FROM (VALUES (0, ';', '', '', true), (1, '|', '', '', false), (2, chr(9), '', '', true), (3, ',', '', '', false),
      (4, ',', '"', '', true), (5, ';', chr(39), '', false), (6, ',', '"', '\\', false), (7, '|', chr(39), '\\', true)) t(variant, d, q, e, h)),
f AS (SELECT n.n_regionkey * 10 + v.variant AS id, v.*, n.c + (CASE WHEN v.h THEN 1 ELSE 0 END) >= 5 AS is_csv FROM n, v)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN is_csv THEN d END AS delimiter, CASE WHEN is_csv THEN q END AS quote,
       CASE WHEN is_csv THEN e END AS escape, CASE WHEN is_csv THEN h END AS header FROM f""")
def agg_7_dialect(spark, sf_dir):
    """CSV dialect inference: delimiter × quote × escape by row-pattern
    consistency and cell-type coherence over ≥ 5 lines, header by a first-line /
    type vote, on per-region nation files in eight dialects.  Quoted names hold
    the delimiter and the quote."""
    n = read(spark, sf_dir, "nation")
    texts = []
    for i, (d, quote, escape, h) in enumerate(DIALECTS):
        name = F.col("n_name")
        if quote:
            inner = escape + quote if escape else quote * 2
            name = F.concat(F.lit(quote), name, F.lit(f"{d} the {inner}"), name, F.lit(inner + quote))
        body = (n.groupBy("n_regionkey")
                 .agg(F.listagg(F.concat_ws(d, F.col("n_nationkey").cast("string"), name,
                                            F.col("n_regionkey").cast("string")), "\n").alias("t")))
        hdr = F.lit(d.join(["key", "name", "region"]) + "\n") if h else F.lit("")
        texts.append(body.select((F.col("n_regionkey") * 10 + i).cast("bigint").alias("id"),
                                 F.concat(hdr, F.col("t")).alias("text")))
    u = texts[0]
    for t in texts[1:]:
        u = u.unionByName(t)
    u = u.select("id", "text", csv_dialect(F.col("text")).alias("d"))
    return u.select("id", "d.delimiter", "d.quote", "d.escape", FM.csv_has_header(F.col("text"), F.col("d")).alias("header"))


def _write_fixtures(spark, sf_dir):
    base = scratch_path(spark, "tabular-fixtures")
    FM.write_csv_text(read(spark, sf_dir, "nation"), f"{base}/a_csv", ";", True)
    FM.write_csv_text(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"),
                      f"{base}/b_csv", "|", False)
    FM.write_json_arrays(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"),
                         f"{base}/c_json", rows_per_file=500)
    read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.json(f"{base}/d_ndjson")
    read(spark, sf_dir, "region").write.parquet(f"{base}/e_parquet")
    return base


@register("src_9_cascade", """
SELECT 'csv' AS format, ';' AS delimiter, true AS header, count(*) AS num_rows, 3::BIGINT AS num_cols FROM nation
UNION ALL SELECT 'csv', '|', false, count(*), 3 FROM supplier
UNION ALL SELECT 'json', '', false, count(*), 3 FROM customer
UNION ALL SELECT 'ndjson', '', false, count(*), 3 FROM part
UNION ALL SELECT 'parquet', '', false, count(*), 2 FROM region""")
def src_9_cascade(spark, sf_dir):
    """Format cascade over a folder of mixed files written from driver tables:
    Parquet / JSON array / NDJSON / CSV (two dialects) classified from bytes,
    each class read by one native reader; rows and columns per class."""
    base = _write_fixtures(spark, sf_dir)
    parts = []
    for c, df in FM.read_cascade(spark, base):
        ncols = len([x for x in df.columns if x != "_file"])
        parts.append(df.agg(F.count(F.lit(1)).alias("num_rows")).select(
            F.lit(c["format"]).alias("format"), F.lit(c["delimiter"] or "").alias("delimiter"),
            F.lit(bool(c["header"])).alias("header"), "num_rows",
            F.lit(ncols).cast("bigint").alias("num_cols")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("src_8_csv", """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation
UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier""")
def src_8_csv(spark, sf_dir):
    """CSV scans with sniffed dialects round-trip the driver tables."""
    base = _write_fixtures(spark, sf_dir)
    out = []
    for c, df in FM.read_cascade(spark, base):
        if c["format"] != "csv":
            continue
        cols = [x for x in df.columns if x != "_file"]
        out.append(df.select(F.col(cols[0]).cast("bigint").alias("n_nationkey"), F.col(cols[1]).alias("n_name"),
                             F.col(cols[2]).cast("bigint").alias("n_regionkey")))
    return out[0].unionByName(out[1])


@register("src_6_json", """
SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer""")
def src_6_json(spark, sf_dir):
    """JSON-array document scan round-trips customer rows."""
    base = _write_fixtures(spark, sf_dir)
    for c, df in FM.read_cascade(spark, base):
        if c["format"] == "json":
            return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
                             F.round("c_acctbal", 6).alias("c_acctbal"))


@register("src_7_ndjson", """SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part""")
def src_7_ndjson(spark, sf_dir):
    """NDJSON scan round-trips part rows."""
    base = _write_fixtures(spark, sf_dir)
    for c, df in FM.read_cascade(spark, base):
        if c["format"] == "ndjson":
            return df.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name",
                             F.col("p_size").cast("bigint").alias("p_size"))


@register("src_5_parquet", """SELECT count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R'""")
def src_5_parquet(spark, sf_dir):
    """Native Parquet scan with pushed-down filter and pruned columns."""
    li = read(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_returnflag") == "R").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@register("tab_2_lists", """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || ', , ' || CAST(c_custkey % 5 AS VARCHAR) AS ints,
       c_mktsegment || ', ' || c_name AS strs
FROM customer""")
def tab_2_lists(spark, sf_dir):
    """List columns of at most four items joined by ', ' (null items empty);
    the five-item numeric list is dropped."""
    c = read(spark, sf_dir, "customer")
    nested = c.select("c_custkey",
                      F.array(F.col("c_nationkey").cast("bigint"), F.lit(None).cast("bigint"),
                              F.col("c_custkey") % 5).alias("ints"),
                      F.array("c_mktsegment", "c_name").alias("strs"),
                      F.array(*[F.col("c_custkey") + i for i in range(5)]).alias("wide"))
    return TB.flatten(nested)

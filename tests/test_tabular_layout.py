from pyspark.sql import functions as F

from quarry.operators import layout as LY
from quarry.operators import tabular as TB


def test_list_columns_and_cells(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], [1, 2, 3, 4, 5], ["a", None], " a |\n b ")],
                               "k int, short array<int>, long array<int>, s array<string>, c string")
    flat = TB.flatten(df)
    assert flat.columns == ["k", "short", "s", "c"]
    r = flat.select(*[TB.sanitize(F.col(c)).alias(c) for c in flat.columns]).first()
    assert r.short == "1, 2, 3, 4" and r.s == "a," and r.c == "a ¦ b"


def test_struct_fields_go_last(spark):
    df = spark.createDataFrame([(1, (2, (3,)), 4)], "a int, s struct<x:int, y:struct<z:int>>, b int")
    assert TB.flatten(df).columns == ["a", "b", "s.x", "s.y.z"]


def test_row_index_is_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    got = TB.row_index(df, ["k"], partitions=5).orderBy("k").collect()
    assert [r.RowID for r in got] == list(range(1, 5001))


def test_cross_page_table_header(spark):
    p1 = "intro\n\n|A|B|\n|---|---|\n|1|2|"
    p2 = "|x|y|\n|---|---|\n|3|4|"
    df = spark.createDataFrame([([p1, p2, "plain"],)], "pg array<string>")
    got = df.select(LY.join_split_tables(F.col("pg")).alias("f")).first().f
    assert got[1] == "|A|B|\n|---|---|\n|x|y|\n|3|4|"
    assert got[0] == p1 and got[2] == "plain"


def test_cell_whitespace_is_unicode_white_space(spark):
    import regex
    ws = {c for c in range(0x110000) if regex.match(r"\p{White_Space}", chr(c))}
    assert ws == set(TB._WS_CPS)
    cells = [" a |\n b ", " x　|　y ", "\x1cq\x1d", None, "p||q"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r.s for r in df.select(TB.sanitize(F.col("c")).alias("s")).collect()]

    def rule(v):
        if v is None:
            return ""
        v = regex.sub(r"\p{White_Space}+", " ", v).replace("|", "¦")
        return regex.sub(r"^\p{White_Space}+|\p{White_Space}+$", "", v)
    assert got == [rule(c) for c in cells]


def test_row_numbers_follow_the_files(spark, tmp_path):
    lines = {f"f{k}.csv": [f"{k},{i}" for i in range(700 + 31 * k)] for k in range(3)}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    want = [tuple(map(int, r.split(","))) for name in sorted(lines) for r in lines[name]]
    spark.range(1000).selectExpr("id", "id * 3 AS x").coalesce(1).write.parquet(str(tmp_path / "p"), mode="overwrite")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")   # many splits a file
    try:
        df = spark.read.schema("k int, i int").csv(str(tmp_path / "f*.csv"))
        assert df.rdd.getNumPartitions() > 6
        got = sorted((r.RowID, r.k, r.i) for r in TB.file_row_index(df).collect())
        assert got == [(n, *r) for n, r in enumerate(want, 1)]
        p = TB.file_row_index(spark.read.parquet(str(tmp_path / "p"))).collect()
        assert sorted((r.RowID, r.id) for r in p) == [(i + 1, i) for i in range(1000)]
        table = TB.to_table(df)
        assert table.columns == ["RowID", "k", "i"] and table.where("RowID = '701'").first().k == "1"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_table_chunks_hold_whole_rows_in_order(spark):
    table = spark.createDataFrame([(str(i), "x" * (i % 37)) for i in range(1, 400)], "RowID string, a string")
    lines = TB.markdown_lines(table)
    for block in (1, 7, 10_000):
        got = [r.markdown.split("\n") for r in TB.table_chunks(lines, 200, block).orderBy("idx").collect()]
        assert all(c[:2] == ["RowID | a", "- | -"] for c in got)
        assert [x for c in got for x in c[2:]] == [f"{i} | {'x' * (i % 37)}" for i in range(1, 400)]
        assert all(len("\n".join(c[:-1])) <= 200 for c in got) and len(got) > 30
    assert TB.table_chunks(lines.where("line_no < 2"), 200).count() == 0


def test_layout_steps_leave_no_shuffle_files(spark):
    """What a step shuffles goes with its table: a chain's disk is that of its largest step."""
    import time
    from quarry.operators import layout
    from quarry.operators.store import write_staged

    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    def settled(most):
        for _ in range(50):
            if files() <= most:
                break
            time.sleep(0.2)
        return files() <= most
    blocks = spark.range(4).selectExpr("1L doc_id", "1L page_no", "id block_no", "0 block_type", "0.0D x0", "id * 30.0D y0", "100.0D x1", "id * 30.0D + 20 y1")
    spans = blocks.selectExpr("doc_id", "page_no", "block_no", "0L line_no", "0L span_no", "10.0D size", "if(block_no = 1, 16, 0) flags", "concat('w', block_no) text",
                              "x0 + 2 sx0", "y0 sy0", "x0 + 42 sx1", "y0 + 8 sy1")
    links = spark.sql("SELECT 1L doc_id, 1L page_no, n link_no, 0.0 x0, 0.0 y0, 200.0 x1, 20.0 y1, concat('u', n) uri FROM VALUES 1, 2 AS t(n)")
    images = spark.sql("SELECT 1L doc_id, 1L page_no, 1 img_no, 0.0 x0, 0.0 y0, 1.0 x1, 1.0 y1, 's' sha256 WHERE false")
    tables = spark.sql("SELECT 1L doc_id, 1L page_no, 1 table_no, 0.0 x0, 60.0 y0, 90.0 x1, 70.0 y1, '|a|b|' markdown, 2 n_rows, 2 n_cols")
    before = files()
    assert write_staged(spark.range(20_000).selectExpr("id % 1000 as k").groupBy("k").count(), "t-staged").count() == 1000
    assert settled(before + 20)
    before = files()
    items = layout.page_items(blocks, spans, links, images, tables)
    assert settled(before + 20), (before, files())
    got = {r.grp: r.text for r in items.collect()}
    assert got == {1: "[w0](u1)", 2: "# **w1**", 3: "|a|b|", 4: "w3"}

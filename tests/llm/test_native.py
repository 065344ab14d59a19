"""Quality rules, line spread, decontamination and mixing."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_spread, mixing, quality_rules
from tests.conftest import SF001
from tests.llm.data import CLASHING, EDGE_ROWS, LONG, alnum, edge_docs, empty_docs, words

LABELS = "doc_id long, quality int, toxic int"


# ---- mixing -------------------------------------------------------------

def test_mixing_edges(spark):
    rows = mixing.mix_sources(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE_ROWS)
    sizes = collections.Counter()
    for i, t, _, s in EDGE_ROWS:
        sizes[s] += len(words(t))
    for r in rows:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(target[s] <= 3 * sizes[s] + 1e-9 for s in target)


def test_mixing_water_level(spark):
    # one tiny heavy source is full at three times its size; the rest is dealt 2 : 1
    docs = spark.createDataFrame([(1, "w " * 10, "en", "a", 0), (2, "w " * 300, "en", "b", 0), (3, "w " * 290, "en", "c", 0)], edge_docs(spark, False).schema)
    got = {r.source: (r.target, r.taken) for r in mixing.mix_sources(docs).collect()}
    assert got["a"] == (30.0, 30) and got["b"] == (380.0, 380) and got["c"] == (190.0, 190)


def test_mixing_reruns_agree_and_empty(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    one, two = (sorted(map(tuple, mixing.mix_sources(d).collect())) for d in (docs, docs.repartition(7)))
    assert one == two
    assert mixing.mix_sources(empty_docs(spark)).count() == 0


def test_mixed_documents_keep_columns(spark):
    out = mixing.mixed_documents(edge_docs(spark))
    assert out.columns == [c for c in edge_docs(spark).columns if c not in ("size", "taken", "target")] + ["size", "source_size", "target", "taken"]
    assert out.where("taken <= 0").count() == 0


# ---- line spread --------------------------------------------------------

def test_lines_removed_across_sites_but_first(spark):
    rows = [(i, f"shared  line\nown line {i}\n\n shared line ", "en", f"s{i % 6}", 0) for i in range(12)]
    rows += [(100 + i, "few sites\nx", "en", f"s{i % 4}", 0) for i in range(8)]
    out = {r.doc_id: r for r in line_spread.dedup_lines(spark.createDataFrame(rows, empty_docs(spark).schema)).collect()}
    assert out[0].text == "shared  line\nown line 0\n" and out[0].n_removed == 1
    assert all(out[i].text == f"own line {i}\n" and out[i].n_removed == 2 and out[i].n_lines == 3 for i in range(1, 12))
    # x and "few sites" stand on four sites only
    assert all(out[100 + i].n_removed == 0 for i in range(8))


def test_line_edges(spark):
    docs = edge_docs(spark)
    out = line_spread.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted(((i, t) for i, t, _, _ in EDGE_ROWS), key=repr)
    assert line_spread.dedup_lines(empty_docs(spark)).count() == 0


def test_spread_threshold_is_exact_near_it(spark):
    lines = spark.createDataFrame([((k, 0), f"s{j}", 0, k, 0) for k in range(2, 9) for j in range(k) for _ in range(3)]
                                  + [((9, 0), None, 0, 9, 0)] * 9, "rid struct<doc_id:long,h:long>, source string, n int, a long, b long")
    got = {r.a for r in line_spread.spread_lines(line_spread.frequent_lines(lines, 5), 5).collect()}
    assert got == {5, 6, 7, 8}
    wide = spark.range(4000).selectExpr("struct(id AS doc_id, id AS h) AS rid", "concat('site', id) AS source", "0 AS n", "1L AS a", "1L AS b")
    assert line_spread.spread_lines(wide, 1000).first().a == 1
    assert line_spread.spread_lines(wide, 5000).count() == 0


# ---- quality rules ------------------------------------------------------

def _stats(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again)


def test_base_statistics(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    edge = [(1000 + k, t) for k, (_, t, _, _) in enumerate(EDGE_ROWS)]
    tricky = [(2000, "a a a a"), (2001, "a b a b a b c"), (2002, "a b c x a b c"), (2003, "r\rr\r\nr\r"), (2004, " \n \n"), (2005, "a b c"), (2006, "a b")]
    rows = real + edge + tricky
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in quality_rules.text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: _stats(t) for i, t in rows}


def test_rules_learn_thresholds_and_keep_clean_rows(spark):
    rows = [(i, (0.01 if i % 4 else 0.3) + i * 1e-6, 5.0 + i % 3, 1 if i % 4 == 0 else 0, i % 3) for i in range(400)]
    features = [f for f in quality_rules.FEATURES if f not in ("symbol_rate", "word_len")]
    df = spark.createDataFrame(rows, "id long, symbol_rate double, word_len double, bad long, part int").selectExpr("*", *[f"0.5D AS {f}" for f in features])
    rules = quality_rules.learn_rules(df)
    assert rules and rules[0][0][0] == "symbol_rate"
    hit = df.withColumn("rule", quality_rules.rules_column(rules))
    assert hit.where("bad = 1 AND rule IS NULL").count() == 0 and hit.where("bad = 0 AND rule IS NOT NULL").count() == 0
    assert quality_rules.learn_rules(df.where("bad = 0")) == []


def test_quality_edges(spark):
    labels = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (6, None, 0), (None, 0, 0), (999, 0, 1), (5, 0, 0)], LABELS)
    out = quality_rules.quality_verdicts(edge_docs(spark), labels)
    rows = out.collect()
    assert len(rows) == len(EDGE_ROWS)
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and (r.kept == (not failed))
    assert {r.doc_id: r.n_words for r in rows}[5] == len(words(LONG))
    assert quality_rules.quality_verdicts(empty_docs(spark), labels).count() == 0
    assert quality_rules.quality_verdicts(edge_docs(spark), labels.limit(0)).count() == len(EDGE_ROWS)


def test_quality_verdicts_separate_the_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF001.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.quality_verdicts(docs, labels).where("NOT base_failed").join(labels, "doc_id")
    t = got.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"),
                F.avg(F.when(F.col("quality") == 0, (~F.col("kept")).cast("int"))).alias("bad")).first()
    assert t.good > 0.97 and t.bad > 0.8


# ---- decontamination ----------------------------------------------------

ITEMS = "item_id long, text string, extra string"


def _brute(docs, items, window=10):
    seen = {}
    for i, t in items:
        w = alnum(t)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            seen.setdefault(tuple(w[s:s + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = alnum(t), set(), set()
        for k in {len(g) for g in seen}:
            for s in range(len(w) - k + 1):
                own = seen.get(tuple(w[s:s + k]))
                if own:
                    hit |= set(range(s, s + k))
                    ids |= own
        names = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_edges(spark):
    phrase = " ".join(f"p{i}" for i in range(14))
    items = [(1, phrase), (2, "Hello, World"), (3, "x"), (4, None), (5, "..."), (1, phrase), (10, phrase), (None, "solo term"), (6, "tok " * 12),
             (7, "absentword " + phrase)]
    docs = [(i, t) for i, t, _, _ in EDGE_ROWS] + [
        (20, phrase), (21, "P0 p1,p2 p3 p4 p5 p6 p7 p8 p9 stop p10"), (22, "hello... WORLD hello world world"), (23, "solo\tterm"), (24, "tok " * 25),
        (25, " ".join(phrase.split()[1:12] + phrase.split()[3:])), (26, "tok " * 9), (20, phrase), (20, "other text with x")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *[f"'e' AS `{c}`" for c in CLASHING])
    b = spark.createDataFrame([(*r, "e") for r in items], ITEMS)
    got = decontaminate.decontaminate(d, b)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(docs, items)
    kept = decontaminate.clean_documents(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(not r[-1] for r in _brute(docs, items))
    assert decontaminate.decontaminate(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_decontamination_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, decontaminate.decontaminate(docs, items, 4).collect()), key=repr)
    want = _brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 4)
    assert got == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare a b c other"), (2, "other x x x x x x x x rare"), (3, "other rare")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare other a"), (2, None)], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.proximity_matches(docs, items, 5).collect()}
    assert got and got <= {1, 2, 3} and 2 not in got


@pytest.mark.parametrize("key", ["op5_line_spread", "op8_decontaminate", "op9_mixing", "op7_warc"])
def test_registered_query_matches_sql(spark, key):
    from quarry.llm.queries import ORACLES, QUERIES
    from tools.check_oracle import duck, rows_of
    got, want = QUERIES[key](spark, SF001).toPandas(), duck(SF001).execute(ORACLES[key]).df()
    assert rows_of(got) == rows_of(want)


def test_a_long_text_of_one_word_is_matched_in_linear_work(spark):
    docs = spark.createDataFrame([(1, " ".join(["tok"] * 50_000)), (2, "x " + " ".join(["tok"] * 9)), (3, " ".join(["tok"] * 10))], "doc_id long, text string")
    items = spark.createDataFrame([("one", "tok"), ("ten", " ".join(["tok"] * 10)), ("no", "tok x")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (50_000, 50_000, 2), 2: (10, 9, 1), 3: (10, 10, 2)}

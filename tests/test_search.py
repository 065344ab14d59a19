import random

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import search as S
from tests.conftest import SF01


def test_ivf_recall_against_exact(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = e.select(F.col("id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id) for r in S.cosine_top_k(e, q, 10, exclude_self=True).collect()}
    approx = {(r.query_id, r.id) for r in S.ivf_top_k(e, q, 10, n_cells=8, exclude_self=True).collect()}
    recall = len(exact & approx) / len(exact)
    assert recall >= 0.9, recall


def test_cosine_batches_equal_single_pass(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = e.limit(30).select(F.col("id").alias("query_id"), "embedding")
    a = {(r.query_id, r.id, r.rank) for r in S.cosine_top_k(e, q, 5).collect()}
    b = {(r.query_id, r.id, r.rank) for r in S.cosine_top_k(e, q, 5, query_block=7, corpus_block=50).collect()}
    assert a == b


def _tri(s):
    import regex
    out = set()
    for w in regex.findall(r"[\p{L}\p{N}]+", s.lower()):
        p = "  " + w + " "
        out |= {p[i:i + 3] for i in range(len(p) - 2)}
    return out


def test_trigram_search_equals_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["alpha", "beta", "gamma", "delta", "the", "and", "of", "é", "naïve", "x1"]
    docs = [(f"c{i}", " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 12)))) for i in range(200)]
    qs = [(j, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 5)))) for j in range(15)]
    ch = spark.createDataFrame(docs, "sha256 string, markdown string")
    q = spark.createDataFrame(qs, "query_id int, text string")
    got = {(r.query_id, r.sha256) for r in S.trigram_search(ch, q, 1000, 0.3).collect()}
    want = set()
    for j, t in qs:
        a = _tri(t)
        for c, m in docs:
            b = _tri(m)
            if a and b and len(a & b) / len(a | b) >= 0.3:
                want.add((j, c))
    assert got == want


def test_top_k_hot_group(spark):
    df = spark.range(0, 20000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("t"),
                                      (F.col("id") % 997).cast("double").alias("s"))
    got = [r.t for r in S.top_k(df, "g", "s", "t", 3).orderBy("rank").collect()]
    assert got == sorted([str(i) for i in range(20000) if i % 997 == 996])[:3]


def test_hash_embed_unit_norm(spark):
    df = spark.createDataFrame([("a b c a",), ("",)], "t string")
    v = [np.array(r.v) for r in df.select(S.hash_embed(F.col("t")).alias("v")).collect()]
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-9 and np.linalg.norm(v[1]) == 0


def test_lineage_approx_close_to_exact(spark):
    fc = spark.range(0, 3000).select((F.col("id") % 300).cast("string").alias("file_sha256"),
                                     (F.col("id") % 7).cast("string").alias("chunk_sha256"))
    src = spark.range(0, 300).select(F.col("id").cast("string").alias("file_sha256"),
                                     (F.col("id") % 40).cast("string").alias("source"))
    exact = {r.chunk_sha256: (r.n_files, r.n_sources) for r in S.lineage(fc, src).collect()}
    approx = {r.chunk_sha256: (r.n_files, r.n_sources) for r in S.lineage(fc, src, approx=True).collect()}
    for k, (f, s_) in exact.items():
        af, as_ = approx[k]
        assert abs(af - f) <= 0.1 * f and abs(as_ - s_) <= 0.1 * s_ + 1


def test_vectors_that_cannot_be_scored_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (None, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (6, [0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = e.selectExpr("id AS query_id", "embedding")
    got = {(r.query_id, r.id) for r in S.cosine_top_k(e, q, 3, exclude_self=True).collect()}
    assert got == {(a, b) for a in (1, 4, 6) for b in (1, 4, 6) if a != b}
    names = e.selectExpr("concat('n', id) AS id", "embedding")
    assert {r.id for r in S.cosine_top_k(names, q, 1).collect()} <= {"n1", "n4", "n5", "n6"}  # n5 is the only one of its length


def test_substring_and_regex_search_equal_a_scan(spark):
    import re
    rnd = random.Random(9)
    vocab = ["alpha", "Beta", "gamma-ray", "x1", "é", "naïve", "ΟΔΟΣ", "a.b", "--", "42", "alphabet"]
    docs = [(f"c{i}", " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 9)))) for i in range(150)] + [("cn", None), (None, "alpha"), ("ce", "")]
    plain = ["alpha", "pha be", "lpha", "Beta gam", "ΟΔΟΣ", "ΔΟΣ", "--", "-", "a.b", "é", "zzz", "", None, "mma-ray x1", " x1 ", "absent alpha"]
    ch = spark.createDataFrame(docs, "sha256 string, markdown string")
    pats = spark.createDataFrame(list(enumerate(plain)), "pattern_id int, pattern string")
    got = {(r.pattern_id, r.sha256) for r in S.substring_search(ch, pats).collect()}
    assert got == {(j, c) for j, p in enumerate(plain) for c, t in docs if p and c is not None and t is not None and p in t}
    rules = [r"alph[ab]et", r"gam+a-ray", r"(alpha|Beta) x1", r"\d+ alpha", r"a\.b", r"^Beta", r"alpha$", r"na.ve", r"Be?ta", r"alpha{1}bet", r"[^ ]+-ray \w1", r"\p{Lu}eta"]
    pats = spark.createDataFrame(list(enumerate(rules)), "pattern_id int, pattern string")
    index = S.build_trigram_index(ch)
    got = {(r.pattern_id, r.sha256) for r in S.regex_search(ch, pats, index=index).collect()}
    import regex
    assert got == {(j, c) for j, p in enumerate(rules) for c, t in docs if c is not None and t is not None and regex.search(p, t)}


def test_index_reads_only_the_buckets_of_its_keys(spark):
    ch = spark.createDataFrame([(f"c{i}", f"word{i} common text") for i in range(500)], "sha256 string, markdown string")
    index = S.build_trigram_index(ch)
    from quarry.operators.text_index import bucket_of
    keys = F.broadcast(spark.createDataFrame([("wor",)], "gram string").withColumn("bucket", bucket_of(F.col("gram"))).where("length(gram) > 0"))
    plan = index.postings.join(keys, ["bucket", "gram"])._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_neighbours_of_each_length(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 7)] + [(10 + i, [float(i), 1.0, 2.0]) for i in range(5)]
    e = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    for block in (2, 4096):
        assert {r.id for r in S.cosine_top_k(e, q, 20, corpus_block=block).collect()} == {10, 11, 12, 13, 14}


def test_shards_and_slices_equal_brute_force(spark, monkeypatch):
    """Copies, repeated ids and the query's own row, over many shards and slices."""
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(90, 8)).round(1)
    rows = [(i, base[i % 60].tolist()) for i in range(150)] + [(3, base[70].tolist()), (3, base[71].tolist()), (200, [0.0] * 8)]
    e = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = e.selectExpr("id AS query_id", "embedding").where("query_id < 40 AND query_id <> 3")
    monkeypatch.setattr(S, "LEAST_SLICE", 5)
    unit = np.array([v for _, v in rows])
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    ids = np.array([i for i, _ in rows])
    for exclude in (True, False):
        got = {}
        for r in S.cosine_top_k(e, q, 4, exclude_self=exclude, shard_values=20 * 8, corpus_block=7, query_block=3).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 9)))
        for i in [i for i in range(40) if i != 3]:
            score = np.einsum("j,ij->i", unit[i], unit).round(12)
            order = [n for n in np.lexsort((ids, -score)) if not (exclude and ids[n] == i)][:4]
            assert sorted(got[i]) == [(r + 1, ids[n], round(float(score[n]), 9)) for r, n in enumerate(order)]


def test_a_query_is_sent_once_to_each_shard(spark, monkeypatch):
    """The vectors of a query do not go out once for every probed cell."""
    rnd = np.random.default_rng(4)
    e = spark.createDataFrame([(i, rnd.normal(size=6).tolist()) for i in range(400)], "id long, embedding array<double>")
    q = e.selectExpr("id AS query_id", "embedding")
    cells, asked, n_probe, centres = S.ivf_plan(e, q, 5, 20, 12, "id", "embedding", "query_id", "embedding", True, 0.95)
    probes = S.probed_cells(asked, centres, n_probe)
    assert probes.count() == 400 and {len(set(r.cells)) for r in probes.collect()} == {12}
    wide = {(r.query_id, r.id) for r in S.ivf_top_k(e, q, 5, n_cells=20, n_probe=20, exclude_self=True).collect()}
    assert wide == {(r.query_id, r.id) for r in S.cosine_top_k(e, q, 5, exclude_self=True).collect()}


def test_postings_hold_numbers_not_ids(spark):
    """Ids stand once in the head row of a part; counts, lengths and frequencies are exact."""
    from quarry.operators.text_index import HEAD, PART_ROWS  # noqa: F401
    docs = [("c1", "b a b"), ("c2", "a"), ("c3", None), (None, "a a"), ("c4", "")]
    index = S.build_term_index(spark.createDataFrame(docs, "sha256 string, markdown string"))
    rows = index.postings.collect()
    assert (index.rows, index.words) == (5, 6)
    head = [r for r in rows if r.term == HEAD]
    assert len(head) == 1 and sorted(map(str, head[0].ids)) == ["None", "c1", "c2", "c3", "c4"]
    size = dict(zip(head[0].ids, head[0].lengths))
    assert (size["c1"], size["c2"], size[None], size["c3"]) == (3, 1, 2, 0)
    got = {r.term: {head[0].ids[d]: t for d, t in zip(r.docs, r.tfs)} for r in rows if r.term != HEAD}
    assert got == {"a": {"c1": 1, "c2": 1, None: 2}, "b": {"c1": 2}} and all(r.ids is None for r in rows if r.term != HEAD)


def test_parts_are_indexed_and_scored_apart(spark, monkeypatch):
    """Over many parts, buckets written by several tasks and blocks of queries: BM25 and trigrams by brute force."""
    import math
    from quarry.operators import text_index as T
    for name, value in (("PART_ROWS", 7), ("BUCKET_PARTS", 3), ("QUERY_ROWS", 2)):
        monkeypatch.setattr(T, name, value)
    rnd = random.Random(6)
    vocab = ["alpha", "beta", "gamma", "delta", "the", "x1", "naïve"]
    docs = [(f"c{i:03}", " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 12)))) for i in range(90)]
    qs = [(j, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 3)))) for j in range(5)]
    ch, q = spark.createDataFrame(docs, "sha256 string, markdown string"), spark.createDataFrame(qs, "query_id int, text string")
    words = {c: t.split() for c, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    for r in [S.bm25(ch, q, 200).collect()]:
        got = {(x.query_id, x.sha256): round(x.score, 9) for x in r}
    want = {}
    for j, t in qs:
        for c, w in words.items():
            s = 0.0
            for x in set(t.split()):
                df = sum(x in o for o in words.values())
                tf = w.count(x)
                s += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if s > 0:
                want[j, c] = round(s, 9)
    assert got == want
    got = {(r.query_id, r.sha256) for r in S.trigram_search(ch, q, 200, 0.3).collect()}
    assert got == {(j, c) for j, t in qs for c, m in docs if len(_tri(t) & _tri(m)) >= 0.3 * len(_tri(t) | _tri(m))}


def test_index_build_shuffles_texts(spark, monkeypatch):
    """Trigrams are many times as long as their text: they are taken after the shuffle."""
    from quarry.operators import text_index as TI
    seen, dealt = [], TI._dealt
    monkeypatch.setattr(TI, "_dealt", lambda rows, parts: seen.append(set(rows.columns)) or dealt(rows, parts))

    chunks = spark.createDataFrame([("a", "some words here"), ("b", "other words"), ("c", None)], "sha256 string, markdown string")
    index = TI.build_trigram_index(chunks)
    assert seen == [{"part", "id", "text"}]
    got = {(r.gram, r.df) for r in index.frequencies.collect()}
    assert ("wor", 2) in got and ("som", 1) in got

"""Collocations against counting every phrase, and SQL."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import collocations as co
from tests.conftest import SF001
from tests.llm.data import LOWER, edge_docs, empty_docs

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def _brute(rows, longest=3, least=10, percent=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = collections.Counter()
        for p, a in many.items():
            for inner in {p[i:i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}:
                around[inner] = max(around[inner], a)
        best = []
        for p, a in many.items():
            if around[p] and 100 * around[p] >= percent * a:
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def _got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def _random_rows(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "on", "mat", "Ünï", "a\tb", "x"] + [f"w{i}" for i in range(60)]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" "] * 12 + [". ", ",", "\n", "  "]) for _ in range(rng.randrange(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize("longest,least", [(3, 10), (3, 2), (4, 3), (2, 5)])
def test_against_counting_every_phrase(spark, longest, least):
    rows = _random_rows(400)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = _brute(rows, longest, least)
    assert _got(co.collocations(df, longest, least)) == want and want


def test_first_ranks_and_crowded_slots(spark, monkeypatch):
    rows = _random_rows(400, 2)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    monkeypatch.setattr(co, "HELD", 500)
    monkeypatch.setattr(co, "FEWEST_SLOTS", 6)     # so few slots that most reach the bound: the sums decide
    monkeypatch.setattr(co, "MOST_SLOTS", 6)
    assert _got(co.collocations(df, least=3, top=7)) == _brute(rows, least=3, top=7)


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    want = sorted(con.sql(co.ORACLE).fetchall())
    assert _got(co.collocations(spark.read.parquet(f"{SF001}/documents.parquet"))) == want and want


def test_edges(spark):
    rows = [(r.lang, r.text) for r in edge_docs(spark, False).collect()]
    assert _got(co.collocations(edge_docs(spark))) == _brute(rows)
    assert _got(co.collocations(empty_docs(spark))) == []
    ties = [("en", "b c. a b. d e")] * 10 + [("", "q r")] * 10
    df = spark.createDataFrame(ties, "lang string, text string")
    assert [(r.lang, r.rank, r.phrase, r.score) for r in co.collocations(df).orderBy("lang", "rank").collect()] == [
        ("", 1, "q r", 1000000), ("en", 1, "d e", 1000000), ("en", 2, "a b", 500000), ("en", 3, "b c", 500000)]


def test_a_long_text_is_cut_anywhere_but_counted_whole(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(5000)) + ". " + "z" * 300 + " end"
    whole = next(co.words_in_pieces(pa.array([text])))
    for size in (17, 64, 1000):
        monkeypatch.setattr(co, "PIECE_BYTES", size)
        part = next(co.words_in_pieces(pa.array([text])))
        assert all(np.array_equal(x, y) for x, y in zip(whole[1:6], part[1:6]))


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    words = [[1], [3], [1, 3]]
    counts = spark.createDataFrame([("en", w, f) for w, f in zip(words, (big, big + 1, big - 1))], "lang string, words array<long>, f long")
    assert co.cut_scores(counts).first().score == 1000000 * (big - 1) ** 2 // (big * (big + 1))

"""MinHash, language ID, LM scoring, toxicity, WARC and suffix arrays."""

import collections
import gzip
import hashlib
import io
import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import language_id, suffix_array, suffix_tree_lm, tokens, toxicity, warc, weighted_minhash
from quarry.session import scratch_path
from tests.conftest import SF001, SF01
from tests.llm.data import EDGE_ROWS, LOWER, alnum, edge_docs, empty_docs, held, words


# ---- tokens -------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.x\x01", max_size=30)), max_size=12))
def test_word_hashes_follow_the_words(texts):
    for table, rule in ((tokens.NOT_BLANK, lambda t: words((t or "").translate(LOWER))), (tokens.ALNUM, alnum)):
        seen, at = {}, 0
        for first, counts, h in tokens.word_hashes(pa.array(texts, pa.string()), table):
            assert first == at
            at += len(counts)
            cut = tokens.starts_from(counts)
            for k, n in enumerate(counts):
                want = rule(texts[first + k])
                assert n == len(want)
                for w, x in zip(want, h[cut[k]:cut[k + 1]], strict=True):
                    assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_long_texts_are_cut_at_gaps(monkeypatch):
    text = " ".join(f"w{i % 300}" for i in range(3000)) + " " + "y" * 500
    whole = np.concatenate([h for _, _, h in tokens.word_hashes(pa.array([text]))])
    monkeypatch.setattr(tokens, "PIECE_BYTES", 64)
    monkeypatch.setattr(tokens, "pieces", lambda offsets: [(i, i + 1) for i in range(len(offsets) - 1)])
    cut = np.concatenate([h for _, _, h in tokens.word_hashes(pa.array([text]))])
    assert (whole == cut).all() and len(whole) == 3001


# ---- MinHash ------------------------------------------------------------

def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    g = np.sort(rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2))
    w = rng.uniform(1, 4, 900).astype(np.float32)
    a, b = slice(0, 700), slice(200, 900)
    wb = w.copy()
    wb[400:500] *= 1.7
    sampler = weighted_minhash.Sampler(2000)
    sig = sampler.signatures(np.array([700, 0, 700]), np.concatenate([g[a], g[b]]), np.concatenate([w[a], wb[b]]))
    both = np.zeros((2, 900))
    both[0, a], both[1, b] = w[a], wb[b]
    true = both.min(axis=0).sum() / both.max(axis=0).sum()
    assert len(sig) == 2 and abs((sig[0] == sig[1]).mean() - true) < 0.05


def _brute_classes(rows, idf):
    sets = {}
    for i, t in rows:
        for *_, g, times in weighted_minhash.shingle_sets(pa.array([t], pa.string())):
            if len(g):
                sets[i] = dict(zip(g.tolist(), weighted_minhash.weights_of(g, times, idf).tolist(), strict=True))
    near = collections.defaultdict(set)
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            lesser = sum(min(v, sets[j][x]) for x, v in s.items() if x in sets[j])
            if lesser / (sum(s.values()) + sum(sets[j].values()) - lesser) >= 0.8:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in sorted(sets):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += near[x]
    return out


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    idf = weighted_minhash.idf_table(*weighted_minhash.document_frequencies(docs))
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(docs).collect()}
    want = _brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], idf)
    assert len(got) == docs.count()
    differing = sum(got[i] != want.get(i, i) for i in got)
    assert differing <= 2  # a pair at the threshold shares a band with probability 0.986


def test_near_duplicates_chain_and_edges(spark):
    base = [f"v{i}" for i in range(120)]

    def edited(n):
        w = list(base)
        for k in range(n):
            w[k * 17] = f"new{n}"
        return " ".join(w)
    rows = [(50, edited(0)), (51, edited(1).upper()), (52, edited(2) + " !!!"), (60, "wholly different words " * 20), (61, "one two"), (62, "ONE, two.")]
    docs = edge_docs(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    out = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(docs).collect()}
    assert out[50] == out[51] == out[52] == 50
    assert out[60] == 60 and out[61] == out[62] == 61
    assert out[1] == 1 and out[2] == 2 and out[None] is None
    assert len(out) == len({i for i, *_ in EDGE_ROWS} | {i for i, _ in rows})
    kept = weighted_minhash.distinct_documents(docs)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in out.items() if c == i}
    assert weighted_minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_classes_close_long_chains(spark):
    links = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b").union(spark.createDataFrame([(500, 400), (600, 500)], "a long, b long"))
    got = {r.id: r.label for r in weighted_minhash.classes(links).collect()}
    assert all(got[i] == 0 for i in range(200)) and {got[i] for i in (400, 500, 600)} == {400}


# ---- language ID --------------------------------------------------------

def test_language_accuracy_and_rows(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = language_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in out)
    test = [r.lang == r.lang_pred for r in out if r.held_out]
    assert sum(test) / len(test) > 0.97


def test_language_inputs_are_text_only(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    one = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_languages(docs).collect()}
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang"))).withColumn("source", F.lit("x"))
    two = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_languages(hidden).collect()}
    assert one == two


def test_language_edges(spark):
    out = language_id.predict_languages(edge_docs(spark)).collect()
    assert len(out) == len(EDGE_ROWS)
    for r in out:
        if r.doc_id in (1, 2, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de")
    assert language_id.predict_languages(empty_docs(spark)).count() == 0
    unlabelled = edge_docs(spark, False).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict_languages(unlabelled).collect()} == {"und"}
    kept = language_id.identified_documents(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert not {1, 2, 3, 4} & {r.doc_id for r in kept.collect()}


# ---- LM scoring ---------------------------------------------------------

def test_lm_base_scores_and_counts(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").union(edge_docs(spark, False).selectExpr("doc_id + 100000", "text"))
    out = suffix_tree_lm.lm_scores(docs, heavy=300).collect()
    text = docs.collect()
    count = collections.Counter()
    for r in text:
        if not held(r.doc_id, 7, 2):
            count.update([*words((r.text or "").translate(LOWER)), "\0"])
    total = sum(count.values())
    want = collections.Counter()
    for r in text:
        w = [*words((r.text or "").translate(LOWER)), "\0"]
        base = sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in w)
        want[(r.doc_id, held(r.doc_id, 7, 2), len(w), sum(count[x] > 0 for x in w), total, round(base, 4))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    test = [r for r in out if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_lm_is_a_distribution(spark):
    """The tree's rows sum to 1 and the longest retained suffix is used."""
    rng = np.random.default_rng(1)
    bits = suffix_tree_lm.SYMBOL_BITS
    sym = rng.integers(0, 5, 4000)
    for k in range(2, 4000):
        if sym[k - 1] == 3 and sym[k - 2] == 2:
            sym[k] = 4
    ctx = suffix_tree_lm.contexts(sym.astype(np.int32), np.zeros(1, np.int64))
    codes, n = np.unique((ctx << bits) | sym, return_counts=True)
    kept, rows = suffix_tree_lm.grow_tree(codes, n, gain=5e-3)
    assert np.allclose((10.0 ** rows.astype(float)).sum(axis=1), 1, atol=1e-4)
    state = suffix_tree_lm.state_table(kept)
    after = (2 << bits) | 3
    assert after in kept[1].tolist() and 10 ** rows[state[after], 4] > 0.9
    absent = (100 << bits) | 3
    assert state[absent] == state[3] and 3 in kept[0].tolist()


def test_lm_edges(spark):
    out = suffix_tree_lm.lm_scores(edge_docs(spark)).collect()
    assert len(out) == len(EDGE_ROWS) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert suffix_tree_lm.lm_scores(empty_docs(spark)).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(60) if held(i, 7, 2)], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known) for r in suffix_tree_lm.lm_scores(only_held).collect()} == {(0, 0)}


# ---- toxicity -----------------------------------------------------------

def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF01.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out")
    r = got.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rate = {x.toxic: x.p for x in r}
    assert rate[1] > 0.65 and rate[0] < 0.01


def test_toxicity_edges(spark):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 1), (6, 1, 0), (8, 1, None), (None, 1, 1), (999, 0, 1)], schema)
    out = toxicity.toxicity_scores(edge_docs(spark), labels).collect()
    assert len(out) == len(EDGE_ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id, 5, 0) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert {r.predicted for r in toxicity.toxicity_scores(edge_docs(spark), labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity_scores(empty_docs(spark), labels).count() == 0


def test_ftrl_is_sparse():
    rng = np.random.default_rng(2)
    rows = [(int(k % 3 == 0), np.unique(np.append(rng.integers(10, 1000, 40), np.full(int(k % 3 == 0), 5)))) for k in range(900)]
    slots, weights, _ = toxicity.fit_ftrl(rows, bits=10)
    assert slots[np.argmax(weights)] == 5 and len(slots) < 500


# ---- WARC ---------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    big, hot = "é" * 700, "<p>" + "x" * 2000
    rows = [(1, "http://a/1", big, "e"), (2, None, big, "e"), (3, "http://a/\n3", "short", "e"), (4, "u", "short", "e"), (5, "u", None, "e"), (6, "u", "", "e"),
            (None, "u", big, "e"), (7, "u", "y" * 1000, "e"), (7, "u", "y" * 1000, "e"), (8, "u", "WARC/1.1\r\n\r\n" * 200, "e"), (9, "u", "z" * 300000, "e")]
    rows += [(100 + i, "u", hot, "e") for i in range(50)]
    pages = spark.createDataFrame(rows, PAGES)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(warc.record_roles(pages), folder, archive_bytes=2000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(spark, manifest).collect()
    assert [r for r in got if r.error] == []

    def want(i, html):
        raw = (html or "").encode()
        same = [j for j, _, h, _ in rows if h == html and j is not None]
        to = max(same) if i is not None and len(raw) >= 1000 and i < max(same) else None
        return (i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to, raw if to is None else None)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=repr) \
        == sorted((want(i, h) for i, _, h, _ in rows), key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_members_and_broken_records():
    good = warc.record_bytes(1, "u", b"payload", None)
    stream = warc._member(good) + warc._member(good[:-3]) + warc._member(good.replace(b"payload", b"pAyload")) + warc._member(b"junk")
    assert gzip.decompress(warc._member(good)) == good
    got = [warc.parse_record(d)["error"] for d, e in warc.members(io.BytesIO(stream), block=7)]
    assert got == [None, "content length does not frame the record", "block digest differs", "no record header"]
    cut = list(warc.members(io.BytesIO(warc._member(good) + warc._member(good)[:-9]), block=5))
    assert cut[0] == (good, None) and cut[1][1] == "truncated member"
    assert "bad member" in list(warc.members(io.BytesIO(b"not gzip at all")))[0][1]


def test_warc_reading_goes_on_after_damage():
    """Any one byte changed in the second of five records: the others are read."""
    records = [warc.record_bytes(i, f"u{i}", (f"payload {i} " * 40).encode() + bytes(range(256)), None) for i in range(5)]
    packed = [warc._member(r) for r in records]
    for at in range(0, len(packed[1]), 11):
        for change in (0x01, 0x80, 0xFF):
            broken = bytearray(packed[1])
            broken[at] ^= change
            stream = packed[0] + bytes(broken) + b"".join(packed[2:])
            for block in (13, 1 << 16):
                got = list(warc.members(io.BytesIO(stream), block=block))
                fine = [d for d, e in got if e is None and warc.parse_record(d)["error"] is None]
                assert [r for r in fine if r != records[1]] == [records[0], *records[2:]], (at, change, block)
    torn = packed[0] + packed[1][:60] + b"\x1f\x8b\x08 no member" * 9 + packed[2]
    got = list(warc.members(io.BytesIO(torn), block=10))
    assert [d for d, e in got if e is None] == [records[0], records[2]] and sum(e is not None for _, e in got) == 1 and "skipped" in got[1][1]


# ---- suffix arrays ------------------------------------------------------

def _repeated(rows, k=50):
    where = collections.defaultdict(set)
    tok = [(i, words((t or "").translate(LOWER))) for i, t in rows]
    for i, w in tok:
        for s in range(len(w) - k + 1):
            where[tuple(w[s:s + k])].add(i)
    return {(i, x) for i, w in tok for s in range(len(w) - k + 1) if len(where[tuple(w[s:s + k])]) > 1 for x in range(s, s + k)}


def _places(spans):
    return {(r.doc_id, x) for r in spans for x in range(r.start_word, r.end_word)}


def test_suffixes_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert _places(suffix_array.repeated_spans(docs).collect()) == _repeated(rows)
    assert _places(suffix_array.repeated_spans(docs, 17).collect()) == _repeated(rows, 17)


def test_suffix_edges(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    short = " ".join(f"q{i}" for i in range(49))
    rows = [(20, f"lead words {passage} tail"), (21, passage.upper()), (22, f"{short} x"), (23, f"y {short}"), (24, f"{passage} {passage} end"),
            (25, " ".join(f"r{i}" for i in range(60)) + " | " + " ".join(f"r{i}" for i in range(60))), (26, "z " * 300), (27, "z " * 90),
            (28, passage), (28, passage)]
    docs = edge_docs(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    spans = suffix_array.repeated_spans(docs).collect()
    assert _places(spans) == _repeated([(i, t) for i, t, _, _ in EDGE_ROWS] + rows)
    by = collections.defaultdict(list)
    for r in spans:
        by[r.doc_id].append((r.start_word, r.end_word, r.first_doc_id, r.is_first))
    assert by[20] == [(2, 57, 20, True)] and by[21] == [(0, 55, 20, False)] and not {22, 23, 25, 5} & set(by)
    assert suffix_array.repeated_spans(empty_docs(spark)).count() == 0

"""Operators against brute force where a fixed size or one candidate would lose something."""

import collections
import math
import os
import time

import numpy as np
import pyarrow as pa

from quarry.llm import suffix_array, suffix_tree_lm, tokens, weighted_minhash
from tests.conftest import SF001
from tests.llm.data import held, words
from tests.llm.test_free import _brute_classes


# ---- LM scoring ---------------------------------------------------------

def _tree_scores(rows, cost):
    """log10 P of each text by the word tree, without hashing or levels; where
    the last word is no retained context the root predicts."""
    lm = suffix_tree_lm
    train = [t.split() for i, t in rows if not held(i, 7, 2)]
    single, after = collections.Counter(), collections.defaultdict(collections.Counter)
    for w in train:
        single.update(w)
        for k in range(1, lm.WORDS + 1):
            for i in range(k, len(w) + 1):
                after[tuple(w[i - k:i])][w[i] if i < len(w) else None] += 1
    code = {w: int(next(tokens.word_hashes(pa.array([w])))[2][0].view(np.int64)) for w in single}
    top = {w for w, _ in sorted(single.items(), key=lambda x: (-x[1], code[x[0]]))[:lm.SYMBOLS - 2]}
    other, types = sum(n for w, n in single.items() if w not in top), sum(w not in top for w in single)
    whole = sum(single.values()) + len(train) + lm.SYMBOLS

    def root(w):
        if w is None or w in top:
            return ((len(train) if w is None else single[w]) + 1) / whole
        spelled = single[w] - lm.DISCOUNT if w in single else max(lm.DISCOUNT * types, lm.DISCOUNT)
        return (other + 1) / whole * spelled / max(other, 1)

    def p(c, w):
        if not c:
            return root(w)
        n = sum(after[c].values())
        seen = {x: m for x, m in after[c].items() if m >= lm.LEAST}
        return (seen.get(w, 0) + (lm.PRIOR + n - sum(seen.values())) * p(c[1:], w)) / (n + lm.PRIOR)

    kept = set()
    for c in [c for c, x in after.items() if sum(x.values()) >= lm.LEAST]:
        n = sum(after[c].values())
        seen = [w for w, m in after[c].items() if m >= lm.LEAST]
        lam = (lm.PRIOR + n - sum(after[c][w] for w in seen)) / (n + lm.PRIOR)
        bits = sum(p(c, w) * math.log2(p(c, w) / p(c[1:], w)) for w in seen) + lam * max(0, 1 - sum(p(c[1:], w) for w in seen)) * math.log2(lam)
        if seen and n * bits >= cost:
            kept |= {c[k:] for k in range(len(c))}
    out = {}
    for i, t in rows:
        w, score = t.split(), 0.0
        for at in range(len(w) + 1):
            c = next((tuple(w[at - k:at]) for k in range(min(lm.WORDS, at), 0, -1) if tuple(w[at - k:at]) in kept), ())
            score += math.log10(p(c, w[at] if at < len(w) else None))
        out[i] = score
    return out, kept


def test_lm_contexts_of_rare_words_and_of_three_words(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        w = [f"c{x}" for x in rng.integers(0, 220, 60)]
        if i % 5 == 0:  # after x and y alone anything may come; only all three words tell
            w[20:20] = ["rare", "x", "y", "told"]
        if i % 5 == 1:
            w[20:20] = ["seldom", "x", "y", f"c{i}"]
        rows.append((i, " ".join(w)))
    rows += [(1000, "rare x y told"), (1001, "rare x y other"), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, kept = _tree_scores(rows, 6.0)
    assert ("rare", "x", "y") in kept and max(map(len, kept)) == 3
    # without the symbol tree, which has its own test
    for heavy in (1 << 22, 30):
        got = {r.doc_id: r.score for r in suffix_tree_lm.lm_scores(docs, gain=1e9, heavy=heavy, cost=6.0).collect()}
        assert all(abs(got[i] - want[i]) < 1e-3 for i in want), max((abs(got[i] - want[i]), i) for i in want)
    # "told" after the three words is near certain, as a word outside the most frequent ones
    assert got[1000] - got[1001] > 1
    monkeypatch.setattr(suffix_tree_lm, "FULL", 64)
    again = {r.doc_id: r.score for r in suffix_tree_lm.lm_scores(docs, gain=1e9, heavy=30, cost=6.0).collect()}
    assert all(abs(got[i] - again[i]) < 1e-6 for i in got)


def test_lm_tasks_hand_on_small_sorted_parts(spark, monkeypatch):
    """A task sums runs in parts of ``HELD`` rows, whose sizes change no count."""
    docs = spark.createDataFrame([(" ".join(f"w{(i * j) % 7}" for j in range(40)),) for i in range(60)], "text string")
    every = np.full(1 << 4, 2 ** 64 - 1, np.uint64)

    def counted():
        return sorted(map(tuple, suffix_tree_lm.next_counts(docs, 2, every).collect()))
    assert 24 * suffix_tree_lm.HELD <= 16 << 20
    want = counted()
    monkeypatch.setattr(suffix_tree_lm, "HELD", 32)
    assert want and counted() == want


def test_lm_shuffle_files_go_with_the_write(spark):
    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    def shuffled(n):
        return spark.range(n).selectExpr("id % 1000 as k").groupBy("k").count().where("count > 0")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), files()
    out = suffix_tree_lm.written(shuffled(20_000), "t-written")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(key) == setting
    assert out.count() == 1000


def test_lm_look_ups_are_packed_by_part(spark, monkeypatch):
    """Many parts, chunks and flushes: the scores of the whole tree, and no row per document and run."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(260):
        w = [f"c{x}" for x in rng.integers(0, 200, 40)]
        w[10:10] = ["all", "all", "all", f"k{i % 9}", f"v{i % 9}", "then", f"t{i % 4}"]
        rows.append((i, " ".join(w)))
    rows += [(1000, "k3 v3 then"), (1001, "k3 v4 then"), (1002, ""), (1003, "all " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, kept = _tree_scores(rows, 40.0)
    assert kept
    for name, size in (("PART", 400), ("ASK", 300), ("HELD", 256)):
        monkeypatch.setattr(suffix_tree_lm, name, size)
    out = suffix_tree_lm.lm_scores(docs, gain=1e9, heavy=40, cost=40.0)
    got = {r.doc_id: r.score for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in want), max((abs(got[i] - want[i]), i) for i in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_lm_wide_contexts_are_dealt_over_parts(spark):
    """Counts are the same in any number of parts, also of a context that is dealt over all."""
    docs = spark.createDataFrame([(" ".join(f"w{(i * j) % 7}" for j in range(40)),) for i in range(60)], "text string")
    every = np.full(1 << 4, 2 ** 64 - 1, np.uint64)
    want = sorted(map(tuple, suffix_tree_lm.next_counts(docs, 1, every).collect()))
    wide = np.unique(np.array([want[0][0], want[-1][0]], np.int64).view(np.uint64))
    assert sorted(map(tuple, suffix_tree_lm.next_counts(docs, 1, every, every, 9, wide).collect())) == want


def test_lm_pairs_name_common_words_by_rank():
    """The words with a rank take two bytes each; every pair comes back, in any mix of ranks and hashes."""
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(1, 2 ** 64, 400, np.uint64))
    ctx, word = rng.choice(words, 6000), rng.choice(np.append(words, np.uint64(0)), 6000)
    ctx, word, n = suffix_tree_lm._pairs(ctx, word, np.full(6000, suffix_tree_lm.LEAST))
    want = sorted(zip(ctx.view(np.int64).tolist(), word.view(np.int64).tolist(), n.tolist(), strict=True))
    size = []
    for common in (words[:0], words[::2], np.append(np.uint64(0), words)):
        for heads in (words[:0], common):
            rows = pa.Table.from_batches([suffix_tree_lm._packed_pairs(ctx, word, n, 5, words[:3], heads, common)])
            got = [suffix_tree_lm._summed_pairs(rows.slice(i, 1), heads, common) for i in range(rows.num_rows)]
            assert rows.num_rows == 5 and sorted(tuple(x.values()) for t in got for x in t.to_pylist()) == want
            size.append(sum(len(x) for c in ("rank", "word") for x in rows.column(c).to_pylist()))
    assert size[-1] == 2 * len(word) and size[0] == 10 * len(word)


def test_lm_disk_holds_what_is_read_later(spark, monkeypatch):
    """Staged tables go with their last reader; the documents are scored in slices, each once."""
    def folders():
        top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
        return {x for x in os.listdir(top) if x.startswith("lm-")}

    rows = [(i // 2 if i % 7 else None, " ".join(f"w{(i * j) % 11}" for j in range(30))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, suffix_tree_lm.lm_scores(docs, heavy=5, cost=1.0).collect()), key=str)
    monkeypatch.setattr(suffix_tree_lm, "PART", 300)
    there, looked, real = folders(), [], suffix_tree_lm.staged

    def staged(df, name):
        looked.append((name, len(folders() - there)))
        return real(df, name)
    monkeypatch.setattr(suffix_tree_lm, "staged", staged)
    out = suffix_tree_lm.lm_scores(docs, heavy=5, cost=1.0)
    names = [name for name, _ in looked]
    assert names.count("lm-scores") == suffix_tree_lm.SLICES and {x.rsplit("-", 1)[0] for x in folders() - there} == {"lm-scores"}
    # words, and one table of each level before it; the answers alone while documents are scored
    assert [n for name, n in looked if name == "lm-next"] == [1, 2, 3]
    assert [n for name, n in looked if name == "lm-scores"] == [1, 2, 3, 4]
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == len(whole) == 80
    for a, b in zip(whole, got, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6


# ---- suffix arrays ------------------------------------------------------

def _first_spans(rows, k):
    """(document, start, end, first document) of each window's lowest document, chained where windows overlap."""
    where, tok = collections.defaultdict(set), [(i, [w.lower() for w in words(t)]) for i, t in rows]
    for i, w in tok:
        for s in range(len(w) - k + 1):
            where[tuple(w[s:s + k])].add(i)
    out = set()
    for i, w in tok:
        spans = {}
        for s in range(len(w) - k + 1):
            docs = where[tuple(w[s:s + k])]
            if len(docs) > 1:
                own = spans.setdefault(min(docs), [])
                if own and s < own[-1][1]:
                    own[-1][1] = s + k
                else:
                    own.append([s, s + k])
        out |= {(i, a, b, f) for f, own in spans.items() for a, b in own}
    return out


def test_overlapping_passages_keep_each_first_document(spark):
    w = [f"w{i}" for i in range(300)]
    text = lambda *parts: " ".join(x for a, b in parts for x in w[a:b])
    rows = [(1, text((200, 205), (0, 60))), (2, text((40, 100), (210, 240))), (3, text((0, 100))), (4, text((240, 250), (20, 90))), (5, text((0, 100), (250, 260)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    get = lambda df, k: {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in suffix_array.repeated_spans(df, k).collect()}
    got = get(docs, 50)
    assert got == _first_spans(rows, 50)
    assert (3, 0, 60, 1) in got and (3, 40, 100, 2) in got
    assert get(docs, 17) == _first_spans(rows, 17)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    assert get(docs, 17) == _first_spans([tuple(r) for r in docs.collect()], 17)


# ---- MinHash ------------------------------------------------------------

def test_no_link_is_lost_in_a_large_class(spark):
    """x is near to one text m of a class of hundreds and to no other: neither
    the lowest of a bucket nor one drawn member is m."""
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(104)]
        rows += [(1000 * g + j, " ".join([*base, *(f"g{g}v{j}t{k}" for k in range(8))])) for j in range(150)]
        rows += [(1000 * g + 500, " ".join(base)), (1000 * g + 501, " ".join(base[:88]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    idf = weighted_minhash.idf_table(*weighted_minhash.document_frequencies(docs))
    want = _brute_classes(rows, idf)
    assert all(want[1000 * g + 501] == 1000 * g for g in range(6))
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(docs).collect()}
    assert got == want


def test_growing_tables_do_not_pass_the_driver(spark, monkeypatch):
    """Sides that grow with the corpus are shuffled, also where the planner takes
    them to be small (a side dealt over salts looks a sixteenth of its length)."""
    plans = []
    kept = weighted_minhash.staged

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)
    monkeypatch.setattr(weighted_minhash, "staged", noted)
    monkeypatch.setattr(weighted_minhash, "HELD", -1, raising=False)  # no key table is held
    base = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{base} x{i}") for i in range(6)] + [(9, "other words are here for once")], "doc_id long, text string")
    out = weighted_minhash.near_duplicates(docs)
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    assert {r.doc_id: r.class_id for r in out.collect()} == {**dict.fromkeys(range(6), 0), 9: 9}
    told = {n for n, p in plans if "Broadcast" in p}
    assert told <= {"minhash-links", "minhash-last"}, told  # pairs are sent by their true size, texts are not


def test_prefix_pairs_hold_every_pair_at_the_threshold(spark):
    """Texts at all similarities around the threshold, each a class of its own,
    all in one bucket: no pair at it is missing, most others are passed over."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(150)]
        for j in range(25):
            text, edits = list(base), rng.integers(0, 9)
            for at in rng.integers(0, 150, edits):
                text[at] = f"e{rng.integers(0, 40)}" if rng.random() < 0.5 else f"own{g}-{j}-{at}"
            rows.append((100 * g + j, " ".join(text[rng.integers(0, 12):150 - rng.integers(0, 12)] + ["the same end"] * 3)))
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    idf = weighted_minhash.idf_table(*weighted_minhash.document_frequencies(texts))
    members = texts.selectExpr("doc_id AS id", "doc_id AS label")
    got = weighted_minhash.prefix_pairs(members, texts, idf, 0.8).collect()
    assert len({(r.a, r.b) for r in got}) == len(got) and all(r.a > r.b for r in got)
    sets = {}
    for i, t in rows:
        for *_, g, times in weighted_minhash.shingle_sets(pa.array([t], pa.string())):
            sets[i] = dict(zip(g.tolist(), weighted_minhash.weights_of(g, times, idf).tolist()))
    near, n = set(), 0
    for a in sets:
        for b in sets:
            if b < a:
                n += 1
                lesser = sum(min(v, sets[b][x]) for x, v in sets[a].items() if x in sets[b])
                if lesser / (sum(sets[a].values()) + sum(sets[b].values()) - lesser) >= 0.8:
                    near.add((a, b))
    found = {(r.a, r.b) for r in got}
    assert near and near <= found and len(found) < len(near) + 0.05 * n


def test_a_bucket_of_thousands_of_one_member_classes(spark):
    """Unlike texts that share a passage, all in one bucket: pairs are not made."""
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"own{i}w{k}" for k in range(60))) for i in range(3000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    idf = weighted_minhash.idf_table(*weighted_minhash.document_frequencies(texts))
    members = texts.selectExpr("doc_id AS id", "doc_id AS label")
    assert weighted_minhash.prefix_pairs(members, texts, idf, 0.8).count() == 0

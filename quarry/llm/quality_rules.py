"""Quality rules: decision lists learned by sequential covering.

Every document gets a row of statistics, all of them Column expressions over
the whole text.  The labelled rows' statistics are cut into histogram bins;
one grouped aggregate (statistic × bin × class) prices every threshold of every
statistic at once, so a rule grows by one small Spark job per condition and is
pruned by another on rows it has not seen.  No rows are sampled and none reach
the driver: it sees one histogram per step.  The finished list is emitted as a
single ordered CASE expression.

A rule grows while a condition raises its FOIL gain; it is then cut back to the
prefix with the best (bad − good) / (bad + good) on the prune third.  Covering
ends when a rule's precision falls below ``min_precision`` or it covers fewer
than ``min_cover`` bad rows.

Defined cases: null text has no words (base_failed); null labels and labels of
unknown documents are ignored, repeated label rows count once by their lowest
quality; without bad labels the list is empty and every document that passes
the base rules is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prepare, staged, words_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BINS = 32
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.75
MIN_COVER = 3
#: Statistics that the rules may test.
FEATURES = ("word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "stop_rate", "words_per_line", "log_words",
            "distinct_rate", "end_rate")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted by (hash, position); equal neighbours are repeats, and
    the positions of the repeats, sorted, give the covered words by their gaps."""
    def cover(pos: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(pos) - 1), F.lit(0),
                           lambda acc, i: acc + F.when(i + 1 == F.size(pos), F.lit(3)).otherwise(F.least(F.lit(3), pos[i + 1] - pos[i])))

    def repeats(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), lambda p: F.when(F.size(p) == 0, 0).otherwise(cover(p)))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
        return F.when(F.size(w) < 4, 0).otherwise(let(F.sort_array(windows), repeats))

    return let(words, of)


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, …) → doc_id, the base counts and the further statistics."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    solid = F.translate(text, BLANKS, "")
    words = words_of(F.col("text"))
    s = docs.select(
        "doc_id",
        let(words, lambda w: F.struct(
            F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
            F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("n_short"))).alias("w"),
        F.length(solid).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda a: F.struct((F.size(a) - F.size(F.array_distinct(a))).alias("dup"), F.size(a).alias("n"),
                                      F.size(F.filter(a, lambda x: F.rtrim(x).rlike(r"[.!?]$"))).alias("ended"))).alias("l"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"))
    n, chars = F.greatest(F.col("w.n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    n_lines = F.greatest(F.col("l.n"), F.lit(1))
    return s.select(
        "doc_id", F.col("w.n_words").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        (F.col("word_chars") / n).alias("word_len"), (F.col("n_symbols") / chars).alias("symbol_rate"),
        (F.col("l.dup") / n_lines).alias("dup_line_rate"), (F.col("w.n_repeat_words") / n).alias("repeat_rate"),
        (F.col("n_upper") / chars).alias("upper_rate"), (F.col("w.n_short") / n).alias("stop_rate"),
        (F.col("w.n_words") / n_lines).alias("words_per_line"), F.log(n).alias("log_words"),
        (F.col("w.n_distinct") / n).alias("distinct_rate"), (F.col("l.ended") / n_lines).alias("end_rate"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _holds(rule) -> Column:
    """Conjunction of (statistic, side, threshold) conditions."""
    out = F.lit(True)
    for name, side, t in rule:
        out = out & ((F.col(name) <= F.lit(t)) if side == "<=" else (F.col(name) > F.lit(t)))
    return out


def rules_column(rules) -> Column:
    """The ordered list as one CASE expression: the number of the first rule
    that holds, null if none does."""
    out = None
    for k, rule in enumerate(rules):
        out = F.when(_holds(rule), F.lit(k)) if out is None else out.when(_holds(rule), F.lit(k))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def _histogram(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Per statistic and bin: [good, bad] counts.  One aggregate; the result has
    at most FEATURES × (BINS + 1) rows."""
    cells = []
    for name, cuts in edges.items():
        b = F.lit(0)
        for c in cuts:
            b = b + (F.col(name) > F.lit(c)).cast("int")
        cells.append(F.struct(F.lit(name).alias("f"), b.alias("b")))
    got = (rows.select("bad", F.explode(F.array(*cells)).alias("c")).groupBy("c.f", "c.b")
           .agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad")).collect())
    out = {name: [[0, 0] for _ in range(len(cuts) + 1)] for name, cuts in edges.items()}
    for r in got:
        out[r["f"]][r["b"]] = [r["good"], r["bad"]]
    return out


def _best_condition(hist, edges):
    """The threshold with the largest FOIL gain over the rows in ``hist``."""
    best = (1e-9, None)
    for name, cuts in edges.items():
        good, bad = (sum(x[j] for x in hist[name]) for j in (0, 1))
        if not bad or not good:
            continue
        start, g, p = math.log2(bad / (bad + good)), 0, 0
        for k, cut in enumerate(cuts):
            g, p = g + hist[name][k][0], p + hist[name][k][1]
            for side, gg, pp in (("<=", g, p), (">", good - g, bad - p)):
                if pp:
                    gain = pp * (math.log2(pp / (pp + gg)) - start)
                    if gain > best[0]:
                        best = (gain, (name, side, cut))
    return best[1]


def learn_rules(rows: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
                min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[list[tuple[str, str, float]]]:
    """rows(FEATURES…, bad 0/1, part 0–2) → ordered rules for the bad rows.
    ``part`` 0 prunes, 1 and 2 grow."""
    quantiles = [k / BINS for k in range(1, BINS)]
    got = rows.agg(*[F.percentile_approx(f, F.array(*map(F.lit, quantiles)), 10000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(got[f] or [])) for f in FEATURES}
    rules: list = []
    while len(rules) < max_rules:
        left = rows.where(F.coalesce(rules_column(rules), F.lit(-1)) < 0) if rules else rows
        rule: list = []
        while len(rule) < max_conditions:
            cond = _best_condition(_histogram(left.where((F.col("part") != 0) & _holds(rule)), edges), edges)
            if cond is None or cond in rule:
                break
            rule.append(cond)
        if not rule:
            break
        parts = [F.struct(F.sum(F.when(_holds(rule[:k]), 1 - F.col("bad"))).alias("good"),
                          F.sum(F.when(_holds(rule[:k]), F.col("bad"))).alias("bad")).alias(f"k{k}") for k in range(1, len(rule) + 1)]
        prune = left.where(F.col("part") == 0).agg(*parts).first()
        whole = left.agg(*parts).first()

        def worth(x):
            g, b = x["good"] or 0, x["bad"] or 0
            return (b - g) / (b + g) if b + g else -1.0
        k = max(range(1, len(rule) + 1), key=lambda j: (worth(prune[f"k{j}"]), worth(whole[f"k{j}"]), -j))
        good, bad = whole[f"k{k}"]["good"] or 0, whole[f"k{k}"]["bad"] or 0
        if bad < min_cover or bad < min_precision * (bad + good):
            break
        rules.append(rule[:k])
    return rules


def quality_verdicts(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """docs(doc_id, text, …), labels(doc_id, quality, …) → doc_id, base counts,
    base_failed, kept, rule (number of the rule that rejects, else null)."""
    prepare(docs.sparkSession)
    stats = staged(text_statistics(docs), "quality-stats")
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    rows = staged(stats.where(~base_failed()).dropDuplicates(["doc_id"]).join(marks, "doc_id")
                  .select(*FEATURES, F.col("bad").cast("long").alias("bad"),
                          F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("part")), "quality-rows")
    rules = learn_rules(rows, **learning)
    rule = rules_column(rules)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
                        (~base_failed() & rule.isNull()).alias("kept"), F.when(~base_failed(), rule).alias("rule"))

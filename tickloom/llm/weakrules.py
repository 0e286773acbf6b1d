"""Weak supervision of quality rules, in DataFrame functions only.

Each rule votes good, votes bad or abstains on a document. A document's votes form a
pattern; there are at most ``3 ** rules`` patterns, so one count of patterns carries all
that expectation-maximisation needs: every round is an aggregate over that small table.
The posterior of a pattern is the quality probability of its documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SPACE = r"[\x20\x09-\x0D]"
#: rule: (statistic, good if at most, bad if above); between them it abstains. Each way in
#: which a text goes wrong is seen by two or more rules, which is what lets
#: expectation-maximisation tell their accuracies without labels.
RULES = {
    "symbol_words": ("n_symbols / nullif(n_words, 0)", 0.05, 0.2),
    "symbol_chars": ("n_symbols / nullif(word_chars, 0)", 0.01, 0.05),
    "letters": ("1 - n_letters / nullif(word_chars, 0)", 0.12, 0.2),
    "letterless": ("n_letterless / nullif(n_words, 0)", 0.1, 0.25),
    "capitals": ("n_upper / nullif(n_letters, 0)", 0.15, 0.35),
    "shouting": ("n_bangs / nullif(n_words, 0)", 0.05, 0.2),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", 0.15, 0.35),
    "lines": ("n_dup_lines / nullif(n_lines, 0)", 0.15, 0.35),
    "word_length": ("abs(word_chars / nullif(n_words, 0) - 6.5)", 3.0, 5.5),
}
START = (0.85, 0.99, 0.3)  # prior of good, accuracy on good, accuracy on bad
ROUNDS = 40
TOLERANCE = 1e-5


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over the whole text (null: no words, no lines).

    Words in repeated windows: the windows' hashes are sorted with their places, equal
    neighbours give the places, and overlapping windows count a word once.
    """
    text = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    cut = text.select(
        "doc_id",
        F.filter(F.split("t", SPACE + "+"), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]")).alias("lines"),
        (F.length("t") - F.regexp_count("t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_bangs"),
    )
    counts = ("word_chars", "n_symbols", "n_letters", "n_upper", "n_bangs")
    sized = cut.select(
        "doc_id",
        *counts,
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: ~x.rlike(r"\p{L}"))).cast("long").alias("n_letterless"),
        F.when(
            F.size("w") > 2,
            F.expr(
                "sort_array(transform(sequence(0, size(w) - 3),"
                " i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i)))"
            ),
        ).alias("s"),
    )
    counts = (*counts, "n_words", "n_lines", "n_dup_lines", "n_letterless")
    places = sized.select(
        "doc_id",
        *counts,
        F.expr(
            "sort_array(transform(filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false)"
            " or coalesce(get(s, k + 1).h = x.h, false)), x -> x.i))"
        ).alias("p"),
    )
    covered = F.expr(
        "aggregate(p, named_struct('n', 0L, 'last', -3),"
        " (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)"
    )
    return places.select("doc_id", *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def votes(stats: DataFrame) -> list[Column]:
    """One vote per rule: 1 good, 0 bad, null abstains (and for texts without words)."""
    out = []
    for name, (value, good, bad) in RULES.items():
        v = F.expr(value)
        out.append(F.when(v <= good, 1).when(v > bad, 0).alias(f"v_{name}"))
    return out


def fit(patterns: DataFrame, rules: list[str]) -> dict[str, float]:
    """Prior and each rule's accuracies (``good_<rule>``, ``bad_<rule>``) by EM.

    ``patterns`` has one row per pattern of votes and its count ``n``. Accuracies are
    probabilities of the right vote given that the rule votes; a rule cannot become
    worse than a coin on good documents, which fixes which class is good.
    """
    prior, good, bad = START
    par = {"prior": prior} | {f"good_{r}": good for r in rules} | {f"bad_{r}": bad for r in rules}
    for _ in range(ROUNDS):
        y = patterns.withColumn("y", posterior(par, rules))
        aggs = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y")]
        for r in rules:
            v = F.col(f"v_{r}")
            for cls, w in (("good", F.col("y")), ("bad", 1 - F.col("y"))):
                right = v if cls == "good" else 1 - v
                aggs.append(F.sum(F.when(v.isNotNull(), F.col("n") * w)).alias(f"{cls}_all_{r}"))
                aggs.append(F.sum(F.when(v.isNotNull(), F.col("n") * w * right)).alias(f"{cls}_right_{r}"))
        s = y.agg(*aggs).first()
        if not s["n"]:
            break
        new = {"prior": (s["y"] + 8) / (s["n"] + 10)}
        for r in rules:
            new[f"good_{r}"] = ((s[f"good_right_{r}"] or 0) + 9.95) / ((s[f"good_all_{r}"] or 0) + 10)
            new[f"bad_{r}"] = ((s[f"bad_right_{r}"] or 0) + 2) / ((s[f"bad_all_{r}"] or 0) + 10)
        new = {k: round(min(max(v, 0.5 if k[0] == "g" else 1e-6), 1 - 1e-6), 9) for k, v in new.items()}
        moved = max(abs(new[k] - par[k]) for k in new)
        par = new
        if moved < TOLERANCE:
            break
    return par


def posterior(par: dict[str, float], rules: list[str]) -> Column:
    """Probability that a document with the row's votes is good."""
    odds = F.lit(math.log(par["prior"] / (1 - par["prior"])))
    for r in rules:
        g, b = par[f"good_{r}"], par[f"bad_{r}"]
        v = F.col(f"v_{r}")
        odds = odds + F.when(v == 1, math.log(g / (1 - b))).when(v == 0, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the statistics, the votes, ``quality`` (posterior) and ``kept``.

    ``base_failed``: fewer than 50 words, or over half the words in repeated 3-word
    windows; such rows are not kept. Others are kept at a posterior of 0.5 or more.
    Null and empty texts have zero counts, no votes and fail; repeated rows are judged
    alike and count as often as they occur; an empty table gives an empty result. Other
    columns are ignored.
    """
    stats = statistics(docs, id_col, text_col)
    rules = list(RULES)
    cols = [f"v_{r}" for r in rules]
    seen = stage(stats.select("*", *votes(stats)))
    patterns = stage(seen.groupBy(*cols).agg(F.count("*").alias("n")).coalesce(1))
    par = fit(patterns, rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = seen.withColumns({"quality": posterior(par, rules), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))

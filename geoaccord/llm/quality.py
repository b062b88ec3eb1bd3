"""Quality rules by weak supervision, in built-in DataFrame functions only.

Rules vote good (+1), bad (-1) or abstain (0). Expectation-maximisation over the counts of the vote patterns
estimates the accuracy of each rule, and the posterior probability of good quality replaces a filter in which
every rule must pass (Dawid & Skene 1979; Ratner et al. 2017).

Cases: a null text counts as the empty text, which has no word, fails the base rule and is not kept; repeated
rows are separate rows with equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, materialize

SYMBOLS = "#*$%&|<>"
#: Rules of the default set, in the order of the vote arrays.
RULES = ("length", "symbols", "lines", "repeats", "capitals", "marks", "bare", "variety")
EM_ROUNDS = 40
#: Where the rounds start: the share of good documents, and the shares of bad, abstain and good votes in each class.
START = {"pi": 0.8, "good": (0.02, 0.13, 0.85), "bad": (0.35, 0.2, 0.45)}
#: Weight of the starting shares beside the observed ones in every round; it keeps the classes from changing sense
#: and, being relative, acts alike for any number of documents.
ANCHOR = 0.25


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``; a plain reference inside a lambda is evaluated per element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort the windows, keep those with an equal
    neighbour, and add up the union of their spans."""
    windows = F.transform(
        F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )
    starts = _let(
        F.sort_array(windows),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and the counts that the rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.translate(x, WORD_SPACE, "") != "")
    words = F.array_remove(F.split(F.translate(F.col("_text"), WORD_SPACE, " " * len(WORD_SPACE)), " "), "")
    in_words = F.translate(F.col("_text"), WORD_SPACE, "")
    counted = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    lined = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
        .select(
            "doc_id",
            counted.alias("w"),
            lined.alias("l"),
            F.length(in_words).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.regexp_count(F.col("_text"), F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
            F.regexp_count(F.col("_text"), F.lit(r"[!?.,;:#*$%&|<>_=~-]{2,}")).cast("long").alias("n_marks"),
            F.regexp_count(F.col("_text"), F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).cast("long").alias("n_bare"),
        )
        .select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_bare")
    )


def votes() -> Column:
    """The vote array of :data:`RULES` over the columns of :func:`features`."""
    c = F.col

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    none = c("n_words") == 0
    return F.array(
        rule((c("n_words") >= 50) & (c("n_words") <= 100_000), c("n_words") < 50),
        rule(c("n_symbols") * 50 <= c("n_words"), none | (c("n_symbols") * 5 >= c("n_words"))),
        rule((c("n_lines") >= 2) & (c("n_dup_lines") * 10 <= c("n_lines")), (c("n_dup_lines") >= 3) & (c("n_dup_lines") * 2 >= c("n_lines"))),
        rule(c("n_repeat_words") * 10 <= c("n_words"), c("n_repeat_words") * 10 > c("n_words") * 3),
        rule(c("n_capitals") * 5 <= c("word_chars"), c("n_capitals") * 5 > c("word_chars") * 2),
        rule(c("n_marks") * 50 <= c("n_words"), none | (c("n_marks") * 5 >= c("n_words"))),
        rule(c("n_bare") * 50 <= c("n_words"), none | (c("n_bare") * 5 >= c("n_words"))),
        rule(c("n_distinct") * 5 >= F.least(c("n_words"), F.lit(200)), none | (c("n_distinct") * 10 < F.least(c("n_words"), F.lit(200)))),
    )


def posteriors(patterns: DataFrame, n_rules: int, rounds: int = EM_ROUNDS) -> DataFrame:
    """Fit the rules on ``patterns`` (votes, n) and return (votes, posterior, rule_accuracy, prior).

    For either class and each rule the model holds the shares of bad, abstain and good votes, so an accuracy can
    differ between the classes: a rule that seldom votes bad, and then is right, outweighs many easy good votes.
    There are at most 3 ** n_rules patterns, whatever the number of documents, so they are folded into one row
    (an array sorted by pattern, which fixes the order of the sums) and the rounds are one ``aggregate``.
    """
    places = F.sequence(F.lit(0), F.lit(3 * n_rules - 1))  # 3 * rule + vote + 1

    each = lambda one: F.flatten(F.array_repeat(F.array(*[F.lit(x) for x in one]), n_rules))
    start = F.struct(F.lit(START["pi"]).alias("pi"), each(START["good"]).alias("good"), each(START["bad"]).alias("bad"))

    def log_odds(v: Column, p: Column) -> Column:
        ratios = F.transform(v, lambda x, j: F.log(F.get(p["good"], 3 * j + x + 1) / F.get(p["bad"], 3 * j + x + 1)))
        return F.aggregate(ratios, F.log(p["pi"] / (1 - p["pi"])), lambda s, x: s + x)

    def total(rows: Column, of) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, r: s + of(r))

    def step(rows: Column, p: Column) -> Column:
        scored = F.transform(rows, lambda r: F.struct(r["v"].alias("v"), r["n"].alias("n"), (1 / (1 + F.exp(-log_odds(r["v"], p)))).alias("q")))

        def shares(q: Column, weight, prior: Column) -> Column:
            mass = lambda k: total(q, lambda r: F.when(F.get(r["v"], F.floor(k / 3).cast("int")) == k % 3 - 1, weight(r)).otherwise(0.0))
            return _let(total(q, weight), lambda m: F.transform(places, lambda k: ((mass(k) + 1.0) / (m + 3.0) + ANCHOR * F.get(prior, k)) / (1 + ANCHOR)))

        good, bad = (lambda r: r["n"] * r["q"]), (lambda r: r["n"] * (1 - r["q"]))
        return _let(scored, lambda q: F.struct(((total(q, good) + 1.0) / (total(q, lambda r: r["n"]) + 2.0)).alias("pi"), shares(q, good, start["good"]).alias("good"), shares(q, bad, start["bad"]).alias("bad")))

    folded = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n")))).alias("rows"))
    fitted = folded.select("rows", _let(F.col("rows"), lambda rows: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda p, _: step(rows, p))).alias("p"))
    p = F.col("p")
    share = lambda j, kind, vote: F.get(p[kind], 3 * j + vote + 1)
    right = lambda j: p["pi"] * share(j, "good", 1) + (1 - p["pi"]) * share(j, "bad", -1)
    wrong = lambda j: p["pi"] * share(j, "good", -1) + (1 - p["pi"]) * share(j, "bad", 1)
    accuracy = F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: right(j) / (right(j) + wrong(j)))
    return fitted.select(F.explode("rows").alias("r"), "p").select(F.col("r.v").alias("votes"), (1 / (1 + F.exp(-log_odds(F.col("r.v"), p)))).alias("posterior"), accuracy.alias("rule_accuracy"), F.col("p.pi").alias("prior"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vote_array: Column | None = None, rules: Sequence[str] = RULES, threshold: float = 0.5) -> DataFrame:
    """Features, votes, posterior probability of good quality, and verdict ``kept`` of every row.

    Texts are read once: the counts (some tens of bytes a row) go to a scratch table, from which both the
    pattern counts and the result come. The posteriors (at most 3 ** rules rows) join by broadcast.
    """
    counted = materialize(features(docs, id_col, text_col).withColumn("votes", votes() if vote_array is None else vote_array), "quality")
    patterns = counted.groupBy("votes").agg(F.count("*").alias("n"))
    fitted = posteriors(patterns, len(rules)).withColumnRenamed("votes", "_votes")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counted.join(F.broadcast(fitted), F.col("votes") == F.col("_votes"))
        .drop("_votes")
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )

"""Quality rules whose cutoffs are chosen under a guaranteed false rejection rate, in DataFrame expressions only.

Every text gets word, symbol, line and repetition counts. A rule rejects a text
whose measure reaches a cutoff. The settings of all rules together form one
fixed sequence: it starts without cutoffs and each step sets the next cutoff of
one rule, so every setting rejects what the one before rejects. In every
stratum a setting is certified if the exact binomial upper bound of its false
rejection rate, taken over the labelled good texts and all rules together,
stays within the allowed rate. The first setting that fails ends the sequence,
so a sequence needs no correction; the error probability is divided by the
number of sequences, which is that of the strata. With probability 1 - ERROR,
every stratum loses at most RISK of its good texts. About 217 labelled good
texts certify a setting that rejects none of them, with four strata.

Defined cases: a null or empty text has no words and fails the base rule. A null
stratum is a stratum of its own. A stratum without (enough) labels gets no
cutoffs and rejects by the base rule alone. A document labelled twice is good
only if all its labels say so; null labels do not count. Repeated rows are
judged one by one. Long texts are counted whole. Empty tables give no rows.
Other columns are kept; those named like a result column are replaced. Columns
named like anything used inside stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.session import materialize

#: allowed share of good texts a stratum may lose to all rules together, and the probability that the promise fails
RISK = 0.02
ERROR = 0.05
#: up to this many strata are sent to every executor; more are joined by a shuffle
BROADCAST_STRATA = 10_000
WINDOW = 8
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: rule -> (measure, cutoffs from the mildest on); a text is rejected where the measure reaches the cutoff
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.3, 0.25, 0.2, 0.15]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]),
}
#: the sequence of settings: step by step the next cutoff of each rule, all first ones before the second ones
STEPS = [
    (name, cuts[level]) for level in range(max(len(cuts) for _, cuts in RULES.values())) for name, (_, cuts) in RULES.items() if level < len(cuts)
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def _covered(repeated: Column) -> Column:
    """Words inside windows that start at the given positions, which are sorted."""
    return F.aggregate(
        repeated, F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            (p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n")
        ),
        lambda acc: acc["n"],
    )


def _repeated_words(hashes: Column) -> Column:
    """Words that stand in a window occurring twice or more."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = lambda s: F.array_sort(F.transform(
        F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.when(j > 0, F.get(s, j - 1)["h"]))),
        lambda x: x["i"],
    ))
    return _let(pairs, lambda s: _covered(starts(s)))


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with the counts of every text and ``n_lines``, ``n_capitals`` and ``base_failed``."""
    added = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    # the input's columns travel in a struct, so that their names cannot clash with those of the steps
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (*COUNTS, "n_lines", "n_capitals", "base_failed")])
    rows = df.select(kept.alias("kept"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("whole"))
    whole = F.col("whole")
    trimmed = F.btrim(whole, F.lit(SPACE_CHARS))
    none = F.expr("cast(array() as array<string>)")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = rows.select(
        "kept", F.when(trimmed != "", F.split(trimmed, SPACE_CLASS, -1)).otherwise(none).alias("_w"), lines.alias("_l"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace(whole, r"[^A-Z]+", "")).alias("n_capitals"),
    ).select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_k1"))
    # keys of 2, 4 and 8 words, each made of two of the keys before; a slice per window would copy whole arrays
    for size in (1, 2, 4):
        shifted = F.slice(f"_k{size}", size + 1, F.greatest(F.size("_w"), F.lit(1)))
        out = out.select("*", F.zip_with(f"_k{size}", shifted, lambda a, b: F.xxhash64(a, b)).alias(f"_k{2 * size}"))
    windows = F.when(F.size("_w") > WINDOW, F.slice(f"_k{WINDOW}", 1, F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))))
    out = out.select(
        "kept", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long"), F.col("n_capitals").cast("long"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), windows.alias("_h"),
    )
    repeats = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _repeated_words(F.col("_h"))).otherwise(0)
    out = out.select("kept", *added, repeats.cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("kept.*", *added, "n_repeat_words", failed.alias("base_failed"))


def _log_factorial(n: Column) -> Column:
    """ln(n!): exact to 20, Stirling's series beyond."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) and k below the mean; terms too far below k to count are left out."""
    log_p, log_q = F.log(F.lit(p)), F.log1p(F.lit(-p))
    first = F.greatest(F.lit(0).cast("long"), k - F.ceil(40 * F.sqrt(n * p)) - 60)
    term = lambda i: F.exp(
        _log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) + i * log_p + (n - i) * log_q
    )
    return F.aggregate(F.sequence(first, k), F.lit(0.0), lambda acc, i: acc + term(i))


def first_setting() -> Column:
    """The number of the mildest setting that rejects a text with these counts; null if none does."""
    return F.least(*[
        F.coalesce(*[F.when(F.expr(measure) >= cut, F.lit(STEPS.index((name, cut)))) for cut in cuts])
        for name, (measure, cuts) in RULES.items()
    ])


def certified_settings(counted: DataFrame, labels: DataFrame, key: str, stratum: str, quality: str = "quality") -> DataFrame:
    """``stratum, n, certified``: labelled good texts and the last certified setting (-1: none) of every stratum that has any."""
    good = labels.filter(F.col(f"`{quality}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.min(f"`{quality}`").alias("least"))
    rows = counted.filter("not base_failed").select(F.col(f"`{key}`").alias("key"), F.col(f"`{stratum}`").alias("stratum"), first_setting().alias("place"))
    rejects = ", ".join(f"count_if(place <= {i})" for i in range(len(STEPS)))
    per_stratum = rows.join(good.filter("least = 1"), "key", "left_semi").groupBy("stratum").agg(
        F.count("*").alias("n"), F.expr(f"array({rejects})").alias("k")
    )
    limit = ERROR / max(1, per_stratum.count())
    tests = per_stratum.select("stratum", "n", F.posexplode("k").alias("place", "k"))
    holds = (F.col("k") < F.col("n") * RISK) & (binomial_at_most(F.col("k"), F.col("n"), RISK) <= limit)
    stop = F.min(F.when(~holds, F.col("place")))
    return tests.groupBy("stratum", "n").agg((F.coalesce(stop, F.lit(len(STEPS))) - 1).alias("certified"))


def apply_rules(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The input without its text, with all counts, ``base_failed``, the rule that rejected it (or null) and ``kept``."""
    added = [*COUNTS, "n_lines", "n_capitals", "base_failed", "rejected_by", "kept"]
    narrow = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added])
    counted = materialize(text_counts(narrow, text).drop(text), "rule_counts")
    settings = materialize(certified_settings(counted, labels, key, stratum), "rule_settings")
    side = F.broadcast(settings) if settings.count() <= BROADCAST_STRATA else settings
    judged = counted.alias("c").join(side.alias("s"), F.col(f"c.`{stratum}`").eqNullSafe(F.col("s.stratum")), "left")
    place = first_setting()
    names = F.array(*[F.lit(name) for name, _ in STEPS])
    hit = F.when(place <= F.col("s.certified"), F.get(names, place))
    rejected_by = F.when(F.col("base_failed"), F.lit("base")).otherwise(hit)
    return judged.select("c.*", rejected_by.alias("rejected_by"), rejected_by.isNull().alias("kept"))

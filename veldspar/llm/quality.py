"""Quality rules with risk-controlled cutoffs, in native DataFrame operations.

Base measures follow fixed definitions: words are runs of characters other than ASCII white space.  A document fails the
base test with fewer than ``MIN_WORDS`` words, or where words in repeated three-word windows make up more than
``MAX_REPEAT`` percent.  On top of it, each rule of ``RULES`` is a score (the higher, the worse) with a grid of cutoffs
fixed beforehand.  Labelled documents are the holdout: for every stratum, rule and cutoff, of the n documents labelled
good, k would be rejected.  A cutoff is admissible if the exact one-sided binomial (Clopper-Pearson) upper bound of the
false rejection rate is at most ``alpha / number of rules``, at confidence ``1 - delta / number of tests`` (Bonferroni
over all strata, rules and cutoffs).  The strictest admissible cutoff of each rule applies; without one, the rule rejects
nothing in that stratum.  So with probability 1 - delta, at most a share alpha of good documents is rejected in every
stratum.  The bound isn't inverted: it is at most a exactly if P(Bin(n, a) <= k) <= the error level.

Null texts count as empty and fail the base test.  A null stratum is one of its own.  Where a document is labelled more
than once, it is good only if all its labels say so; null labels and labels of unknown documents are ignored.  With no
labels, only the base test applies.  Repeated rows get equal verdicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SPACE, SPACE_CHARS, quoted, table, unused

MIN_WORDS, MAX_REPEAT = 50, 50
ALPHA, DELTA = 0.02, 0.05
SYMBOLS = "#*$%&|<>"
#: Parts into which each stratum is cut where strata are joined by shuffle.
SALTS = 64
#: Labelled documents up to which their ids are broadcast (16 MB or so); beyond, documents and labels are joined by shuffle.
MAX_LABELS = 1_000_000
#: rule -> (score over the measures, grid of cutoffs: a document is rejected where its score is above one)
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8]),
    "shouting": ("n_shouts / greatest(n_words, 1)", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8]),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", [0.05, 0.1, 0.2, 0.3, 0.5, 0.7]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.05, 0.1, 0.2, 0.3, 0.4]),
    "word_length": ("abs(word_chars / greatest(n_words, 1) - 6.0)", [1.5, 2.0, 2.5, 3.0, 4.0, 6.0]),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _free(df: DataFrame, names: tuple[str, ...]) -> None:
    taken = {c.lower() for c in df.columns}
    if clash := [n for n in names if n.lower() in taken]:
        raise ValueError(f"columns {', '.join(clash)} are already there")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the five base measures, ``n_lines`` (lines with a word) and ``n_shouts`` (exclamation marks)."""
    _free(df, (*MEASURES, "n_lines", "n_shouts", "_w", "_l", "_t", "_p"))
    full = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(full) - F.length(F.translate(full, chars, ""))
    trimmed = F.btrim(full, F.lit(SPACE_CHARS))
    out = df.withColumns(
        {
            "_w": F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)),
            "_l": F.filter(F.split(full, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0),
            "word_chars": F.length(F.translate(full, SPACE_CHARS, "")).cast("long"),
            "n_symbols": without(SYMBOLS).cast("long"),
            "n_shouts": without("!").cast("long"),
        }
    )
    n = F.size("_w")
    # windows sorted by hash, then words, then place: equal windows become neighbours; the words decide, the hash is a shortcut
    window = lambda i: F.struct(
        F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b"), F.get("_w", i + 2).alias("c"), i.alias("i")
    )
    out = out.withColumn("_t", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))))

    def same(x: Column, y: Column) -> Column:
        return (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)

    twice = F.filter("_t", lambda x, k: F.coalesce((k > 0) & same(x, F.get("_t", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_t", k + 1)), F.lit(False)))
    out = out.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x.i)))
    covered = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_w", "_l", "_t", "_p")


def _where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of df that meet condition, by a filter that stays where it is: a predicate that the optimizer pushes below the
    measures copies their expressions into itself and takes each of them again for every element.  It doesn't push
    predicates through a projection with a column that isn't deterministic."""
    at = unused(df.columns)
    return df.withColumns({f"{at}_ok": condition, f"{at}_bar": F.rand(0)}).where((F.col(f"{at}_ok")) & (F.col(f"{at}_bar") >= 0)).drop(f"{at}_ok", f"{at}_bar")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _at_most(n: Column, k: Column, share: float, level: Column) -> Column:
    """P(Bin(n, share) <= k) <= level, by a running sum of log probabilities; false from the mean on without a sum."""
    first = n * math.log1p(-share)
    ratio = math.log(share) - math.log1p(-share)

    def step(acc: Column, i: Column) -> Column:
        term = acc.term + F.log((n - i + 1) / i) + F.lit(ratio)
        high, low = F.greatest(acc.total, term), F.least(acc.total, term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    total = F.aggregate(F.slice(F.sequence(F.lit(0).cast("long"), k), 2, F.greatest(k, F.lit(1)).cast("int")), F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc.total)
    return F.when((n == 0) | (k >= n * share), F.lit(False)).otherwise(total <= F.log(level))


def labelled_good(labels: DataFrame) -> DataFrame:
    """(_id) of the documents that all their labels call good."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good")).where("_good = 1").select("_id")


def calibrate(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected): the strictest admissible cutoff of each stratum and rule.

    measured: :func:`measures` of at least the labelled documents.  labels: (doc_id, quality 0 or 1).
    """
    truth = labelled_good(labels)
    good = _where(measured, ~base_failed()).select(F.col(doc_id).alias("_id"), F.col(stratum).alias("stratum"), *[F.expr(score).alias(f"s_{rule}") for rule, (score, _) in RULES.items()]).join(truth, "_id", "left_semi")
    tests = [(rule, c) for rule, (_, grid) in RULES.items() for c in grid]
    counted = good.groupBy("stratum").agg(F.count("*").alias("n_good"), *[F.sum((F.col(f"s_{rule}") > c).cast("long")).alias(f"k_{j}") for j, (rule, c) in enumerate(tests)])
    strata = counted.agg(F.count("*").alias("n_strata"))
    rows = counted.crossJoin(F.broadcast(strata)).select("stratum", "n_good", "n_strata", F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k_{j}").alias("n_rejected")) for j, (rule, c) in enumerate(tests)])).alias("t")).select("stratum", "n_good", "n_strata", "t.*")
    admissible = rows.where(_at_most(F.col("n_good"), F.col("n_rejected"), alpha / len(RULES), F.lit(delta) / (F.col("n_strata") * len(tests))))
    best = admissible.groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n_good", "n_rejected")).alias("b"))
    return best.select("stratum", "rule", "b.*")


def verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang", max_strata: int = 1000) -> DataFrame:
    """measured with ``base_failed``, ``failed_rules`` (names) and ``kept``.

    The cutoffs, one row per stratum, are broadcast while there are at most ``max_strata`` of them; beyond that they are
    joined by shuffle, with the strata spread over salts so that a stratum of a third of all rows is no single task.
    """
    _free(measured, ("base_failed", "failed_rules", "kept", "_cut", "_salt", "_want", "_stratum"))
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
    key = F.col(stratum).eqNullSafe(F.col("_stratum"))
    wide = table(wide, "cutoffs")
    if wide.limit(max_strata + 1).count() <= max_strata:
        joined = measured.join(F.broadcast(wide), key, "left")
    else:
        wide = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        plain = [F.col(quoted(f.name)) for f in measured.schema if isinstance(f.dataType, T.AtomicType)]
        left = measured.withColumn("_want", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
        joined = left.join(wide, key & (F.col("_want") == F.col("_salt")), "left").drop("_salt", "_want")
    hit = [F.when(F.expr(score) > F.element_at("_cut", rule), F.lit(rule)) for rule, (score, _) in RULES.items()]
    out = joined.withColumn("failed_rules", F.array_compact(F.array(*hit))).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_cut", "_stratum")


def _parts(docs: DataFrame, doc_id: str, text: str, stratum: str) -> DataFrame:
    """(doc_id, stratum, text) of docs, under names of our own."""
    return docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(stratum)).alias("stratum"), F.col(quoted(text)).alias("text"))


def assess(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, measures, base_failed, failed_rules, kept), measured once and kept in a scratch table.  Other
    columns are not carried."""
    measured = table(measures(_parts(docs, doc_id, text, stratum)).drop("text"), "measures")
    return verdict(measured, calibrate(measured, labels, stratum="stratum"), "stratum").withColumnsRenamed({"doc_id": doc_id, "stratum": stratum})


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of docs that pass, with their columns, whatever their names.  Measures are taken in the same pass that
    filters, and before it of the labelled documents for the cutoffs, so that no text is shuffled."""
    parts = _parts(docs, doc_id, text, stratum)
    good = table(labelled_good(labels), "good")
    few = good.limit(MAX_LABELS + 1).count() <= MAX_LABELS
    holdout = parts.join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("_id"), "left_semi")
    cutoffs = calibrate(measures(holdout), labels, stratum="stratum")
    row = parts.columns
    whole = docs.select(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), *[F.col(quoted(c)).alias(n) for c, n in zip((doc_id, stratum, text), row, strict=True)])
    kept = _where(verdict(measures(whole), cutoffs, "stratum"), F.col("kept"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])

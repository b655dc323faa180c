"""Quality rules: per-document measures and host verdicts under an empirical beta prior.

Only DataFrame functions are used. Every measure is taken inside the row, so that texts are
never shuffled; what is shuffled is one partial sum per host and task.

Defined results
---------------
* A null or empty text has no words, so it fails the base rule (fewer than ``min_words``).
* A null host belongs to no host: it takes no part in the host statistics' verdicts and
  only its own base rule counts.
* Repeated rows are measured, counted and returned as often as they occur.
* An empty table gives an empty result.
* Very long texts are measured whole; a row's measures take memory in proportion to its text. There are no ties to decide:
  measures are counts, and a host's rate at the limit is not over it.
* Columns of the input that clash with an output column are replaced by the output column;
  all other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.llm.shared import written

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column, size: int) -> Column:
    """Words inside a window of `size` words that occurs twice or more, by exact comparison."""
    last = F.size(words) - size

    def window(i: Column) -> Column:
        text = F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])
        return F.struct(text.alias("g"), i.alias("p"))

    def repeated(s: Column) -> Column:
        def twin(j: Column, other: Column) -> Column:
            return F.coalesce(F.get(s, j)["g"] == F.get(s, other)["g"], F.lit(False))

        at = F.filter(F.sequence(F.lit(0), last), lambda j: (F.when(j > 0, twin(j, j - 1)).otherwise(False)) | twin(j, j + 1))
        return F.sort_array(F.transform(at, lambda j: F.get(s, j)["p"]))

    def total(p: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1),
            F.lit(0).cast("long"),
            lambda n, j: n + F.coalesce(F.least(F.lit(size), F.get(p, j + 1) - F.get(p, j)), F.lit(size)).cast("long"),
        )

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), last), window))
    return _let(_let(windows, repeated), lambda p: F.when(F.size(p) > 0, total(p)).otherwise(F.lit(0).cast("long")))


def measured(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """docs with the columns of MEASURES (long).

    Equal windows have equal 64-bit hashes, so a document whose hashes all differ has no
    repeated window; only the others are sorted and compared word by word.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    hashes = F.transform(
        F.sequence(F.lit(0), F.col("__n") - window),
        lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(window)]),
    )
    return (
        docs.withColumn("__words", F.array_remove(F.split(body, SPACE), ""))
        .withColumn("__n", F.size("__words"))
        .withColumn("__lines", lines)
        .withColumn("__hashes", F.when(F.col("__n") > window, hashes))
        .withColumns(
            {
                "n_words": F.col("__n").cast("long"),
                "word_chars": F.length(F.array_join("__words", "")).cast("long"),
                "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "n_repeat_words": F.when(
                    F.size(F.array_distinct("__hashes")) < F.size("__hashes"), _covered(F.col("__words"), window)
                ).otherwise(F.lit(0).cast("long")),
            }
        )
        .drop("__words", "__n", "__lines", "__hashes")
    )


def host_verdicts(rows: DataFrame, host: str, max_host_rate: float) -> DataFrame:
    """One row for each host (``__host``): its shrunk failure rate and whether it is rejected.

    The prior is a beta distribution fitted to the hosts' rates by moments: its mean is the
    overall rate, its strength follows from the variance between hosts beyond what binomial
    sampling explains. It comes from one row of four sums, joined back as a scalar.
    """
    hosts = (
        rows.filter(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("__host"))
        .agg(F.count("*").cast("double").alias("__docs"), F.sum(F.col("base_failed").cast("double")).alias("__failed"))
    )
    sums = hosts.agg(
        F.sum("__docs").alias("n"), F.sum("__failed").alias("f"), F.count("*").alias("h"),
        F.sum(F.col("__failed") * F.col("__failed") / F.col("__docs")).alias("ff"),
    )
    mean = F.col("f") / F.col("n")
    between = F.col("ff") / F.col("n") - mean * mean - mean * (1 - mean) * F.col("h") / F.col("n")
    strength = F.when(between > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / between - 1))).otherwise(F.lit(1e6))
    prior = sums.select(mean.alias("__mean"), strength.alias("__strength"))
    rate = (F.col("__failed") + F.col("__mean") * F.col("__strength")) / (F.col("__docs") + F.col("__strength"))
    # prior is one row by construction
    return hosts.crossJoin(F.broadcast(prior)).select("__host", rate.alias("__rate"), (rate > max_host_rate).alias("__rejected"))


def quality_rules(
    docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 10, max_repeat_percent: int = 20,
    max_host_rate: float = 0.5, keep_text: bool = True,
) -> DataFrame:
    """docs with MEASURES, base_failed, host_rejected and kept.

    kept is false if the base rule fails, or if the host's failure rate, shrunk towards the
    corpus by the beta prior, exceeds `max_host_rate`. The measured rows are written once to
    the shared folder and read for the host sums and for the verdicts; hosts are pre-aggregated
    per task, so one that holds a third of all rows sends one row a task. Spark broadcasts the
    verdicts if their measured size allows, else it sorts and splits skewed hosts.
    """
    rows = measured(docs, text).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    rows = written(rows if keep_text else rows.drop(text), "quality")
    # written, so that its size is known and a small one is broadcast: rows are not dealt by host
    verdicts = written(host_verdicts(rows, host, max_host_rate), "verdicts")
    joined = rows.join(verdicts, F.col(host) == F.col("__host"), "left")
    rejected = F.coalesce(F.col("__rejected"), F.lit(False))
    return joined.withColumns({"host_rejected": rejected, "kept": ~F.col("base_failed") & ~rejected}).drop("__host", "__rate", "__rejected")

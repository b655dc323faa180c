"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts are summed per cell (source, language, topic). The cells' weights are scaled to one
marginal after the other until all three fit. A document's probability is proportional to its
cell's weight per token and calibrated so that the expected tokens meet the budget with no
probability above one; whether it is kept depends on a hash of its id.

Only DataFrame functions are used. Per document nothing is shuffled but partial sums. All rounds run on the table of
cells: up to CELLS of them (counted) are one row of arrays, and all rounds one expression on it, so the driver makes one
plan. A larger table stays a table: marginals are pre-aggregated per task and joined back (Spark splits or broadcasts by
size), and each round is cut by a written table. Both ways give the same weights, and neither leaves out a cell.

Defined results: a null source, language or text counts as its own class ``(none)`` or as an
empty text (0 tokens, the rest topic); documents without tokens get their cell's probability
too; a null id hashes as an empty one, repeated ids share one decision; classes whose target is
absent from the corpus give their share to the others in proportion; an empty table gives an
empty result; input columns that clash with an output column are replaced; very long texts are counted whole, inside the row.
Equal rates need no order: each id's hash decides for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.llm.quality_rules import SPACE
from beamloom.llm.shared import dropped, written

DIMS = ("__source", "__lang", "__topic")
NONE = "(none)"
#: First match wins; other texts are of the rest topic.
TOPICS = {"licence": "(?i)licen[sc]e|all rights reserved", "symbols": r"[#$%&*]{3}", "table": r" \| "}
REST = "prose"
#: A share for each class (classes not listed split the rest by tokens), or a power of the token counts.
TARGETS: tuple[dict[str, float] | float, ...] = (0.5, {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, {"licence": 0.05, "symbols": 0.05, "table": 0.1})
ROUNDS, CALIBRATION_ROUNDS, FRACTION, SEED, TOLERANCE = 12, 8, 0.8, "mix", 1e-10
#: Cells that are raked as arrays of one row (about 100 bytes each); the work of a round grows with their square, some 2 s for all rounds.
CELLS = 512


def _classed(docs: DataFrame, source: str, lang: str, text: str, topics: dict[str, str]) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    topic = F.lit(REST)
    for name, pattern in reversed(topics.items()):
        topic = F.when(body.rlike(pattern), F.lit(name)).otherwise(topic)
    return docs.withColumns(
        {
            "__source": F.coalesce(F.col(source).cast("string"), F.lit(NONE)), "__lang": F.coalesce(F.col(lang).cast("string"), F.lit(NONE)), "__topic": topic,
            "__tokens": F.size(F.array_remove(F.split(body, SPACE), "")).cast("long"),
        }
    )


def _aimed(cells: DataFrame, dim: str, target: dict[str, float] | float) -> DataFrame:
    """One row for each class of a dimension: its share of all tokens to aim at."""
    sums = cells.groupBy(dim).agg(F.sum("__n").cast("double").alias("__m"))
    if isinstance(target, dict):
        left = max(0.0, 1.0 - sum(target.values()))
        given: Column = F.lit(None).cast("double")
        for name, share in target.items():
            given = F.when(F.col(dim) == name, F.lit(float(share))).otherwise(given)
        rest = sums.filter(given.isNull()).agg(F.sum("__m").alias("__rest"))
        raw = sums.crossJoin(F.broadcast(rest)).withColumn("__a", F.coalesce(given, F.try_divide(F.col("__m") * left, "__rest"), F.lit(0.0)))
    else:
        raw = sums.withColumn("__a", F.pow("__m", F.lit(float(target))))
    total = raw.agg(F.sum("__a").alias("__all"))
    return raw.crossJoin(F.broadcast(total)).select(dim, F.coalesce(F.try_divide("__a", "__all"), F.lit(0.0)).alias("__aim"))  # one row on the right


def _raked_in_row(cells: DataFrame, targets, rounds: int, fraction: float, calibration_rounds: int) -> DataFrame:
    """`_calibrated(raked(cells))` of a small table in one expression: cells become arrays of one row, and rounds folds over it."""
    aimed = cells
    for i, (dim, target) in enumerate(zip(DIMS, targets, strict=True)):
        aimed = aimed.join(_aimed(cells, dim, target).withColumnRenamed("__aim", f"__a{i}"), dim)
    fields = [*DIMS, "__n", *[f"__a{i}" for i in range(len(DIMS))]]
    row = aimed.groupBy().agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("c"))
    row = row.select(*[F.col(f"c.{f}").cast("array<double>" if f == "__n" or f.startswith("__a") else "array<string>").alias(f) for f in fields])

    def scaled(w: Column, i: int) -> Column:
        """Weights scaled to the aims of dimension i."""
        have = lambda k: F.aggregate(F.zip_with(DIMS[i], w, lambda c, x: F.when(c == k, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
        return F.transform(w, lambda x, j: x * F.coalesce(F.try_divide(F.get(f"__a{i}", j), have(F.get(DIMS[i], j))), F.lit(0.0)))

    step = lambda w, t: F.when(t % 3 == 0, scaled(w, 0)).when(t % 3 == 1, scaled(w, 1)).otherwise(scaled(w, 2))
    row = row.withColumn("__w", F.aggregate(F.sequence(F.lit(0), F.lit(3 * rounds - 1)), F.col("__n"), step) if rounds else F.col("__n"))
    row = row.withColumn("__total", F.aggregate("__n", F.lit(0.0), lambda s, x: s + x))
    row = row.withColumn("__rate", F.zip_with("__w", "__n", lambda w, n: F.coalesce(F.try_divide(w * F.col("__total"), n), F.lit(0.0))))
    got = lambda s: F.aggregate(F.zip_with("__rate", "__n", lambda r, n: n * F.least(F.lit(1.0), r * s)), F.lit(0.0), lambda t, x: t + x)
    again = F.sequence(F.lit(1), F.lit(calibration_rounds)) if calibration_rounds else F.array().cast("array<int>")
    row = row.withColumn("__scale", F.aggregate(again, F.lit(float(fraction)), lambda s, _: F.coalesce(F.try_divide(s * (F.col("__total") * fraction), got(s)), s)))
    row = row.withColumn("__p", F.transform("__rate", lambda r: F.least(F.lit(1.0), r * F.col("__scale"))))
    return row.select(F.inline(F.arrays_zip(*DIMS, "__rate", "__p")))


def raked(cells: DataFrame, targets=TARGETS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (DIMS, __n) with __w, raked so that its sums by each dimension are the targets' shares: up to so many rounds, fewer once
    no weight moves by more than the tolerance, in relation to itself, in a round. What is left is one number a round on the driver."""
    aims = [written(_aimed(cells, dim, target), "aims") for dim, target in zip(DIMS, targets, strict=True)]
    now = cells.withColumn("__w", F.col("__n").cast("double"))
    for number in range(rounds):
        before = now
        now = now.withColumn("__v", F.col("__w"))
        for dim, aim in zip(DIMS, aims, strict=True):
            factor = now.groupBy(dim).agg(F.sum("__w").alias("__have")).join(aim, dim).select(dim, F.coalesce(F.try_divide("__aim", "__have"), F.lit(0.0)).alias("__f"))
            now = now.join(factor, dim).withColumn("__w", F.col("__w") * F.col("__f")).select(*DIMS, "__n", "__w", "__v")
        now = written(now, "raked")
        if number:
            dropped(before)
        moved = now.agg(F.max(F.try_divide(F.abs(F.col("__w") - F.col("__v")), F.col("__w")))).first()[0]
        now = now.drop("__v")
        if moved is None or moved < tolerance:
            break
    return now


def _calibrated(cells: DataFrame, fraction: float, rounds: int) -> DataFrame:
    """cells with __rate (weight per token against the corpus) and __p, of which the expected tokens are the fraction."""
    total = cells.agg(F.sum("__n")).first()[0] or 0
    cells = cells.withColumn("__rate", F.coalesce(F.try_divide(F.col("__w") * float(total), F.col("__n").cast("double")), F.lit(0.0)))
    scale, budget = fraction, fraction * total
    for _ in range(rounds):  # one number each
        got = cells.agg(F.sum(F.col("__n") * F.least(F.lit(1.0), F.col("__rate") * scale))).first()[0]
        scale = scale * budget / got if got else scale
    return cells.select(*DIMS, "__rate", F.least(F.lit(1.0), F.col("__rate") * scale).alias("__p"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", topics: dict[str, str] = TOPICS,
    targets=TARGETS, fraction: float = FRACTION, seed: str = SEED, rounds: int = ROUNDS, calibration_rounds: int = CALIBRATION_ROUNDS, keep_text: bool = True,
) -> DataFrame:
    """docs with topic, tokens, rate, prob and kept (module text). `prob` and `rate` are rounded to 6 digits."""
    classed = _classed(docs, source, lang, text, topics)
    if not keep_text:
        classed = written(classed.drop(text), "classed")
    cells = written(classed.groupBy(*DIMS).agg(F.sum("__tokens").alias("__n")), "cells")
    few = cells.limit(CELLS + 1).count() <= CELLS
    final = _raked_in_row(cells, targets, rounds, fraction, calibration_rounds) if few else _calibrated(raked(cells, targets, rounds), fraction, calibration_rounds)
    final = written(final, "calibrated")
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":" + seed)))
    uniform = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    return (
        classed.join(final, list(DIMS), "left")
        .withColumns(
            {"topic": F.col("__topic"), "tokens": F.col("__tokens"), "rate": F.round("__rate", 6), "prob": F.round("__p", 6), "kept": uniform < F.col("__p")}
        )
        .drop(*DIMS, "__tokens", "__rate", "__p")
    )


def marginals(mixed: DataFrame, targets=TARGETS, source: str = "source", lang: str = "lang") -> DataFrame:
    """How near a mixture is to its targets: dimension, class, aim, expected (by probabilities) and kept (by decisions), each a share of tokens.
    One row a class. Where a source is small, probabilities end at one, and its expected share stays below the aim."""
    named = mixed.select(F.coalesce(F.col(source).cast("string"), F.lit(NONE)).alias(DIMS[0]), F.coalesce(F.col(lang).cast("string"), F.lit(NONE)).alias(DIMS[1]), F.col("topic").alias(DIMS[2]), "tokens", "prob", "kept")
    n = F.col("tokens")
    cells = named.groupBy(*DIMS).agg(F.sum(n).alias("__n"), F.sum(n * F.col("prob")).alias("__e"), F.sum(F.when(F.col("kept"), n).otherwise(0)).alias("__k"))
    whole = cells.agg(F.sum("__e").alias("__all_e"), F.sum("__k").alias("__all_k"))
    out = None
    for dim, target in zip(DIMS, targets, strict=True):
        sums = cells.groupBy(dim).agg(F.sum("__e").alias("__e"), F.sum("__k").alias("__k")).join(_aimed(cells, dim, target), dim)
        sums = sums.crossJoin(F.broadcast(whole))  # one row on the right
        one = sums.select(F.lit(dim[2:]).alias("dimension"), F.col(dim).alias("class"), F.col("__aim").alias("aim"), F.try_divide("__e", "__all_e").alias("expected"), F.try_divide("__k", "__all_k").alias("kept"))
        out = one if out is None else out.unionByName(one)
    return out


def mix_sql(docs: str, topics=TOPICS, targets=TARGETS, fraction=FRACTION, seed=SEED, rounds=ROUNDS, calibration_rounds=CALIBRATION_ROUNDS) -> str:
    """The CTEs of the same computation in SQL; the last, ``mixed``, has docs' columns and the outputs."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in topics.items()) + f" ELSE '{REST}' END"
    out = [
        f"""classed AS MATERIALIZED (SELECT *, coalesce(source, '{NONE}') AS d0, coalesce(lang, '{NONE}') AS d1, {topic} AS d2,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tk FROM {docs})""",
        "cells AS MATERIALIZED (SELECT d0, d1, d2, sum(tk)::DOUBLE AS n FROM classed GROUP BY ALL)",
    ]
    for i, target in enumerate(targets):
        if isinstance(target, dict):
            case = "CASE " + " ".join(f"WHEN d{i} = '{k}' THEN {v}" for k, v in target.items()) + " END"
            left = max(0.0, 1.0 - sum(target.values()))
            a = f"coalesce({case}, CASE WHEN sum(CASE WHEN {case} IS NULL THEN m END) OVER () > 0 THEN m * {left!r} / sum(CASE WHEN {case} IS NULL THEN m END) OVER () END, 0)"
        else:
            a = f"pow(m, {target!r})"
        out.append(f"a{i} AS MATERIALIZED (SELECT d{i}, CASE WHEN sum(a) OVER () > 0 THEN a / sum(a) OVER () ELSE 0 END AS aim FROM (SELECT d{i}, {a} AS a FROM (SELECT d{i}, sum(n) AS m FROM cells GROUP BY d{i})))")
    last, k = "(SELECT *, n AS w FROM cells)", 0
    for _ in range(rounds):
        for i in range(3):
            out.append(
                f"w{k} AS MATERIALIZED (SELECT d0, d1, d2, n, w * coalesce(CASE WHEN h > 0 THEN aim / h END, 0) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY d{i}) AS h FROM {last}) JOIN a{i} USING (d{i}))"
            )
            last, k = f"w{k}", k + 1
    out.append(f"rated AS MATERIALIZED (SELECT *, CASE WHEN n > 0 THEN w * (SELECT sum(n) FROM cells) / n ELSE 0 END AS r FROM {last})")
    out.append(f"c0 AS MATERIALIZED (SELECT {fraction!r}::DOUBLE AS c, (SELECT sum(n) FROM cells) * {fraction!r} AS b)")
    for k in range(calibration_rounds):
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT CASE WHEN g > 0 THEN c * b / g ELSE c END AS c, b FROM (SELECT any_value(c) AS c, any_value(b) AS b, sum(n * least(1.0, r * c)) AS g FROM rated, c{k}))")
    out.append(f"probs AS MATERIALIZED (SELECT d0, d1, d2, r, least(1.0, r * c) AS p FROM rated, c{calibration_rounds})")
    out.append(
        f"""mixed AS (SELECT classed.*, d2 AS topic, tk AS tokens, round(r, 6) AS rate, round(p, 6) AS prob,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < p AS kept
  FROM classed LEFT JOIN probs USING (d0, d1, d2))"""
    )
    return ",\n".join(out)

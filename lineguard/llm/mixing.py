"""Mixing sources to target weights: raking of token counts, then sampling by calibrated probabilities.

Documents fall into cells (source, language, topic). Iterative proportional fitting scales the cells' tokens
until their sums by source, by language and by topic meet the targets. Each cell gets the probability that, within
a budget of tokens, brings it to its share; a document is in the sample if a hash of its id is below that.
Only built-in expressions are used. All fitting is on the table of cells, which is folded from the documents by one
aggregate, so neither a hot source nor a large corpus makes it longer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineguard.llm.common import few, fresh, held, stage

#: Powers that temper the shares of the corpus into default targets: 1 keeps them, 0 makes them equal.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Relative distance from the targets at which raking ends.
TOLERANCE = 1e-3
#: Raking also ends after a sweep that leaves more than this part of the distance.
STALLED = 0.998
#: Share of all tokens that the sample should hold.
BUDGET = 0.5
_WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words of the whole text, at least 1: an empty document weighs as one word."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)), F.lit(1)).cast("long")


def layout(text: Column, words: Column) -> Column:
    """The topic that is used where a corpus carries none: the kind of writing, from its form."""
    body = F.coalesce(text, F.lit(""))
    bars = F.char_length(body) - F.char_length(F.replace(body, F.lit("|"), F.lit("")))
    lines = F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"), F.lit("")))
    return (
        F.when(20 * bars >= words, "table")
        .when(words < 100, "note")
        .when(10 * lines >= words, "list")
        .when(words < 1000, "article")
        .otherwise("book")
    )


def uniform(id_col: Column, text: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the id's text, or from the text where the id is null."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.md5(F.concat(F.lit(f"{seed} "), name))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """``dim`` and ``target``: the corpus's shares of tokens raised to *power*, adding up to 1."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(power))).alias("mass"))
    total = sums.agg(F.sum("mass").alias("all"))
    return sums.crossJoin(F.broadcast(total)).select(dim, (F.col("mass") / F.col("all")).alias("target"))


def _step(rows: DataFrame, dim: str) -> DataFrame:
    """*rows* with ``share`` scaled so that its sums by *dim* are the targets in ``to_<dim>``."""
    held, target = F.sum("share"), F.coalesce(F.first(f"to_{dim}"), F.lit(0.0))
    factors = rows.groupBy(F.col(dim).alias("__value")).agg(F.when(held > 0, target / held).otherwise(0.0).alias("__factor"))
    scaled = rows.join(factors, rows[dim].eqNullSafe(factors["__value"]))
    return scaled.withColumn("share", F.col("share") * F.col("__factor")).select(*rows.columns)


def off_target(rows: DataFrame, dims: Sequence[str]) -> float:
    """The largest relative distance of a sum of ``share`` from its target ``to_<dim>``, over all values of *dims*; 0 without rows."""
    off = []
    for dim in dims:
        sums = rows.groupBy(dim).agg(F.sum("share").alias("held"), F.first(f"to_{dim}").alias("to")).where("to > 0")
        off.append(sums.select((F.abs(F.col("held") - F.col("to")) / F.col("to")).alias("off")))
    return reduce(DataFrame.unionAll, off).agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """*cells* (with ``tokens``) and ``share``: their weights, whose sums by each dimension follow *targets*.

    Also returns how far the sums stay off, as :func:`off_target`. Sweeps go on until that is at most *tolerance*, or until
    a sweep hardly lowers it, as where no weights meet all targets. A target is a table of the dimension's values and
    their ``target``; null is a value like any other, and a value without a target gets no weight. Sums are combined before
    they are shuffled, so a language or topic that most cells have is no long task.
    """
    out = cells
    for dim, target in targets.items():
        named = target.select(F.col(dim).alias("value"), F.col("target").alias(f"to_{dim}"))
        out = out.join(named, out[dim].eqNullSafe(named["value"]), "left").drop("value")
    out = stage(out.withColumn("share", F.col("tokens").cast("double")), "raked")
    small = few(out)
    out = held(out, small)
    before, off = float("inf"), float("inf")
    while off > tolerance and off <= STALLED * before:
        for dim in targets:
            out = held(stage(_step(out, dim), "raked"), small)  # keeps the plan short
        before, off = off, off_target(out, list(targets))
    return out.drop(*[f"to_{dim}" for dim in targets]), off


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """*cells* (``tokens``, ``share``) and ``probability``, at most 1, for *budget* of all tokens.

    A cell too small for its share is taken whole; the rest of the budget is shared out again among the others, until no
    more cells are whole. Each round is an aggregate of the cells that brings three numbers to the driver.
    """
    chance, taken = F.lit(0.0), -1
    while True:
        whole = chance >= 1
        row = cells.agg(
            (F.sum("tokens") * F.lit(float(budget)) - F.sum(F.when(whole, F.col("tokens")).otherwise(0))).cast("double").alias("left"),
            F.sum(F.when(whole, 0.0).otherwise(F.col("share"))).alias("open"),
            F.count_if(whole).alias("whole"),
        ).first()
        if row["whole"] <= taken or not row["open"] or row["open"] <= 0:
            return cells.withColumn("probability", chance)
        taken = row["whole"]
        chance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(row["left"] / row["open"]) * F.col("share") / F.col("tokens")))


def mix(
    docs: DataFrame,
    topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    seed: int = 0,
    dims: tuple[str, str] = ("source", "lang"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """*docs* with ``topic``, ``tokens``, ``probability``, ``kept`` and ``off_target``, the same for all rows (:func:`off_target`).

    Names that *docs* has already get underscores in front. Null sources, languages and topics are values of their own; null
    texts count as empty; rows that share an id share their decision; an empty table gives an empty result.
    """
    names = {n: fresh(docs, n) for n in ("topic", "tokens", "probability", "kept", "off_target")}
    counted = docs.withColumn(names["tokens"], tokens(F.col(text_col)))
    own_topic = layout(F.col(text_col), F.col(names["tokens"])) if topic is None else topic
    counted = counted.withColumn(names["topic"], own_topic)
    axes = {"source": F.col(dims[0]), "lang": F.col(dims[1]), "topic": F.col(names["topic"])}
    cells = counted.groupBy(*[c.alias(n) for n, c in axes.items()]).agg(F.sum(names["tokens"]).alias("tokens"))
    cells = stage(cells, "cells")
    cells = held(cells, few(cells))
    wanted = targets or {dim: tempered(cells, dim, power) for dim, power in TEMPER.items()}
    raked, off = rake(cells, wanted)
    fitted = calibrate(raked, budget).select(*[F.col(n).alias(f"__{n}") for n in axes], F.col("probability").alias(names["probability"]))
    same = [c.eqNullSafe(fitted[f"__{n}"]) for n, c in axes.items()]
    joined = counted.join(fitted, same[0] & same[1] & same[2], "left").drop(*[f"__{n}" for n in axes])
    joined = joined.withColumn(names["kept"], uniform(F.col(id_col), F.col(text_col), seed) < F.col(names["probability"]))
    return joined.withColumn(names["off_target"], F.lit(off))


def sql(source: str = "documents", columns: str = "doc_id, topic, tokens, probability, kept, off_target") -> str:
    """DuckDB SQL for the rows of :func:`mix` on a table or subquery *source*, with the default targets."""
    parts = [
        f"""counted AS (SELECT *, greatest(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')), 1) AS tokens FROM {source})""",
        """docs AS (SELECT *, CASE
            WHEN 20 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', ''))) >= tokens THEN 'table'
            WHEN tokens < 100 THEN 'note'
            WHEN 10 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) >= tokens THEN 'list'
            WHEN tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM counted)""",
        "cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL)",
    ]
    for dim, power in TEMPER.items():
        parts.append(f"mass_{dim} AS (SELECT {dim}, pow(sum(tokens)::DOUBLE, {power}) AS mass FROM cells GROUP BY {dim})")
        parts.append(f"to_{dim} AS (SELECT {dim}, mass / (SELECT sum(mass) FROM mass_{dim}) AS to_{dim} FROM mass_{dim})")
    joins = " ".join(f"LEFT JOIN to_{d} ON cells.{d} IS NOT DISTINCT FROM to_{d}.{d}" for d in TEMPER)
    goals = ", ".join(f"to_{d}.to_{d} AS to_{d}" for d in TEMPER)
    parts.append(f"step0 AS (SELECT cells.*, {goals}, cells.tokens::DOUBLE AS share FROM cells {joins})")
    sweep = f"(SELECT * FROM raked WHERE off > {TOLERANCE} AND off <= {STALLED} * before)"
    for dim in TEMPER:
        held = f"sum(share) OVER (PARTITION BY {dim})"
        sweep = f"(SELECT * REPLACE (CASE WHEN {held} > 0 THEN share * (coalesce(to_{dim}, 0.0) / {held}) ELSE 0.0 END AS share) FROM {sweep})"
    gaps = ", ".join(f"CASE WHEN to_{d} > 0 THEN abs(sum(share) OVER (PARTITION BY {d}) - to_{d}) / to_{d} ELSE 0.0 END" for d in TEMPER)
    names = f"source, lang, topic, tokens, {', '.join(f'to_{d}' for d in TEMPER)}, share"
    parts.append(
        f"raked AS (SELECT 0 AS k, {names}, 1e300::DOUBLE AS before, 1e299::DOUBLE AS off FROM step0 UNION ALL "
        f"SELECT k + 1, {names}, off, max(gap) OVER () FROM (SELECT *, greatest({gaps}) AS gap FROM {sweep}))"
    )
    open_share = "sum(CASE WHEN probability >= 1 THEN 0.0 ELSE share END) OVER ()"
    rest = f"(sum(tokens) OVER () * {BUDGET}::DOUBLE - sum(CASE WHEN probability >= 1 THEN tokens ELSE 0 END) OVER ())"
    parts.append(
        "filled AS (SELECT 0 AS k, source, lang, topic, tokens, share, off, 0.0::DOUBLE AS probability, -1::BIGINT AS taken "
        "FROM raked WHERE k = (SELECT max(k) FROM raked) UNION ALL "
        "SELECT k + 1, source, lang, topic, tokens, share, off, least(1.0, greatest(0.0, rest / open * share / tokens)), whole FROM "
        f"(SELECT *, {rest} AS rest, {open_share} AS open, count(*) FILTER (probability >= 1) OVER () AS whole FROM filled) WHERE whole > taken AND open > 0)"
    )
    chance = "('0x' || substr(md5('0 ' || coalesce(docs.doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
    same = " AND ".join(f"docs.{d} IS NOT DISTINCT FROM f.{d}" for d in TEMPER)
    parts.append(
        f"mixed AS (SELECT docs.*, f.probability AS probability, {chance} < f.probability AS kept, f.off AS off_target FROM docs "
        f"LEFT JOIN (SELECT * FROM filled WHERE k = (SELECT max(k) FROM filled)) f ON {same})"
    )
    return f"WITH RECURSIVE {', '.join(parts)} SELECT {columns} FROM mixed"

"""Operator 9, mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Documents fall into cells (source, language, topic). The tokens of the cells are
raked: scaled to the target share of each source, then of each language, then of
each topic, again and again. What a cell's tokens end with, against what they were,
is how strongly its documents are drawn. No probability exceeds 1, so the fit is made
under that bound: cells that reach it are held and the others take up what they lack,
until the expected tokens are the wanted part of the corpus and each margin is met, or
comes as near as its values have tokens.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise

#: The fit ends when a round moves no cell by more than this part of the corpus, or after so
#: many rounds, with a warning that names what still moves: margins may contradict each other.
SETTLED, ROUNDS = 1e-8, 128
#: Rounds between two tables.
BLOCK = 4
#: Targets flatten the corpus: a margin's share is its tokens to this power, of the sum.
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 0.5}
#: Expected part of the tokens that is drawn.
KEEP = 0.5
SEED = "mix-1"
#: Cells that are broadcast at most; more of them are joined by shuffle.
BROADCAST_CELLS = 100_000


def form(text: Column) -> Column:
    """The form of a text, for tables that have no column of topics: tabular, shouting, symbols, short, or prose."""
    n = F.length(text)

    def share(chars: str) -> Column:
        left = text
        for c in chars:
            left = F.replace(left, F.lit(c), F.lit(""))
        return F.octet_length(text) - F.octet_length(left)  # of ASCII characters

    return (
        F.when(n < 400, "short")
        .when(share("|") * 40 >= n, "tabular")
        .when(share("!") * 20 >= n, "shouting")
        .when(share("#$%&*") * 20 >= n, "symbols")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Token weight of a text that has not been counted: a token for each four code points, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def flattened_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Share of each value of a margin: its tokens to a power, of the sum of these."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("_t"))
    return own.select(F.col(margin), F.pow(F.col("_t").cast("double"), F.lit(power)).alias("_p")).withColumn("target", F.coalesce(F.try_divide("_p", F.sum("_p").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))).drop("_p")


def scaled_under(df: DataFrame, weight: str, bound: str, amount: Column, by: list, ties: list[str]) -> DataFrame:
    """Multiply `weight` by one number for each group of `by`, so that the sum of min(bound, weight) is the amount, or all are at their bound.

    Rows reach their bounds in order of bound against weight. Were a row and all behind it
    free and those before it held, a number would follow; the largest of these is the one sought.
    """
    group = Window.partitionBy(*by)
    behind = group.orderBy(F.try_divide(F.col(bound), F.col(weight)).desc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, 0)
    scale = F.try_divide(amount - F.sum(bound).over(group) + F.sum(bound).over(behind), F.sum(weight).over(behind))
    return df.withColumn("_scale", scale).withColumn(weight, F.col(weight) * F.greatest(F.lit(0.0), F.coalesce(F.max("_scale").over(group), F.lit(0.0)))).drop("_scale")


def rake(cells: DataFrame, margins: list[str], keep: float, rounds: int = ROUNDS) -> DataFrame:
    """Append `drawn`: the expected tokens of each cell, at most its tokens, fitted to the columns `target_<margin>`.

    Together they are `keep` of all tokens, or as many as cells without a target of 0 have.
    Values of a margin that have fewer tokens than their share asks are drawn whole, and
    the others keep their proportions. Cells of no tokens are drawn by nothing.
    """
    one = Window.partitionBy(F.lit(0))
    free = F.lit(True)
    for m in margins:
        free = free & (F.col(f"target_{m}") > 0)
    fit = cells.withColumn("_bound", F.when(free, F.col("tokens")).otherwise(0).cast("double")).withColumn("weight", F.col("_bound"))
    fit = fit.withColumn("_all", F.sum("tokens").over(one).cast("double")).withColumn("_amount", F.least(F.lit(keep) * F.col("_all"), F.sum("_bound").over(one)))
    for m in margins:
        values = fit.groupBy(m).agg(F.sum("_bound").alias("_has"), F.max(f"target_{m}").alias("_share"), F.max("_amount").alias("_amount"))
        values = scaled_under(values, "_share", "_has", F.col("_amount"), [F.lit(0)], [m])
        fit = fit.join(values.select(m, F.least("_has", "_share").alias(f"_amount_{m}")), m)
    drawn = F.least("_bound", "weight")
    fit = materialise(fit, "bounds")
    for _ in range(0, rounds, BLOCK):
        last = fit
        for i in range(BLOCK):
            fit = fit.withColumn("_before", drawn) if i == BLOCK - 1 else fit
            for m in margins:
                fit = scaled_under(fit, "weight", "_bound", F.col(f"_amount_{m}"), [m], [x for x in margins if x != m])
        fit = materialise(fit, "raked")
        discard(last)
        moved = fit.agg(F.max(F.try_divide(F.abs(drawn - F.col("_before")), F.col("_all")))).first()[0]
        if moved is None or moved <= SETTLED:
            break
    else:
        warnings.warn(f"after {rounds} rounds of raking a cell still moves by {moved:.1e} of all tokens", stacklevel=2)
    return fit.withColumn("drawn", drawn).select(*cells.columns, "drawn")


def uniform(key: Column, seed: str) -> Column:
    """A number from 0 to 1 that hangs on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, seed: str = SEED, topic: Column | None = None, weight: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The documents' columns `columns` (default: all) as the struct `own`, with source, lang, topic, tokens, probability and sampled.

    topic: a column of topics, such as a classifier's labels; without one, the text's form.
    weight: a column of token counts, such as operator 2's; without one, a quarter of the code
    points. targets: for `source`, `lang` and `topic` a table (margin, target) of shares; one
    that is missing is flattened from the corpus; a value that a given table lacks has
    target 0 and is never drawn. Sums over documents fold per cell before the shuffle,
    so a hot source is a few partial rows; raking works on the cells. Few cells are
    broadcast after they have been counted; many are joined by shuffle, where a
    hot cell can be split. Null sources, languages and topics are a value of their own, `?`;
    null and empty texts weigh one token; repeated rows share their fate; an empty table
    stays empty; columns of any name come back as they were.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    topic, weight = form(text) if topic is None else topic.cast("string"), tokens(text) if weight is None else weight.cast("long")
    margins = ["source", "lang", "topic"]
    own = F.struct(*[F.col(f"`{x}`") for x in (docs.columns if columns is None else columns)])
    rows = docs.select(own.alias("own"), F.col("doc_id").alias("key"), *[F.coalesce(x, F.lit("?")).alias(m) for m, x in zip(margins, (F.col("source"), F.col("lang"), topic), strict=True)], F.greatest(F.lit(0), F.coalesce(weight, F.lit(0))).alias("tokens"))
    cell = materialise(rows.groupBy(*margins).agg(F.sum("tokens").alias("tokens")), "cells")
    wide = cell
    for m in margins:
        share = (targets or {}).get(m)
        share = flattened_targets(cell, m, FLATTEN[m]) if share is None else share.select(m, F.col("target").cast("double"))
        wide = wide.join(share.withColumnRenamed("target", f"target_{m}"), m, "left").withColumn(f"target_{m}", F.coalesce(f"target_{m}", F.lit(0.0)))
    fitted = rake(materialise(wide, "targets"), margins, keep)
    chances = materialise(fitted.select(*margins, F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide("drawn", "tokens"), F.lit(0.0))), 9).alias("probability")), "chances")
    if chances.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        chances = F.broadcast(chances)
    drawn = rows.join(chances, margins).withColumn("sampled", uniform(F.col("key"), seed) < F.col("probability"))
    return drawn.select("own", *margins, "tokens", "probability", "sampled")


def mixing_query(docs: DataFrame) -> DataFrame:
    """Cell, token weight, probability and draw of every row; the cases are those of `mix`."""
    found = mix(docs, columns=["doc_id"])
    return found.select("own.doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "probability", "sampled")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that are drawn, with their own columns, whatever these are named."""
    return mix(docs, **options).filter("sampled").select("own.*")


def oracle_sql() -> str:
    """The query in DuckDB's SQL: the fit is a recursion over steps, one margin a step, until a block of rounds has settled."""
    share = lambda c: f"length(t) - length(translate(t, '{c}', ''))"
    margins = list(FLATTEN)
    parts = [f"""
WITH RECURSIVE rows AS (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, coalesce(text, '') AS t FROM documents),
typed AS (SELECT doc_id, source, lang, greatest(1, (length(t) + 3) // 4)::BIGINT AS tokens,
  CASE WHEN length(t) < 400 THEN 'short' WHEN ({share('|')}) * 40 >= length(t) THEN 'tabular' WHEN ({share('!')}) * 20 >= length(t) THEN 'shouting'
       WHEN ({share('#$%&*')}) * 20 >= length(t) THEN 'symbols' ELSE 'prose' END AS topic FROM rows),
cell AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS bound, sum(sum(tokens)) OVER ()::DOUBLE AS everything FROM typed GROUP BY ALL)"""]
    for m, power in FLATTEN.items():
        # Values reach what they have in order of that against their share; the scale is the largest that follows for some number of them.
        parts.append(f"""
v_{m} AS (SELECT {m}, sum(bound) AS has, pow(sum(bound), {power}::DOUBLE) AS p, {KEEP}::DOUBLE * any_value(everything) AS amount FROM cell GROUP BY {m}),
w_{m} AS (SELECT {m}, has, amount, p / sum(p) OVER () AS part FROM v_{m}),
x_{m} AS (SELECT *, (amount - sum(has) OVER () + sum(has) OVER b) / sum(part) OVER b AS scale FROM w_{m} WINDOW b AS (ORDER BY has / part DESC, {m} ROWS UNBOUNDED PRECEDING)),
a_{m} AS (SELECT {m}, least(has, part * greatest(0, max(scale) OVER ())) AS amount_{m} FROM x_{m})""")
    by = "CASE step % 3 " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(margins)) + " END"
    amount = "CASE step % 3 " + " ".join(f"WHEN {i} THEN amount_{m}" for i, m in enumerate(margins)) + " END"
    ties = ", ".join(f"CASE WHEN step % 3 <> {i} THEN {m} END" for i, m in enumerate(margins))
    steps = 3 * BLOCK
    return ",".join(parts) + f""",
fit AS (
  SELECT 0 AS step, source, lang, topic, everything, bound, bound AS weight, bound AS before, FALSE AS settled, amount_source, amount_lang, amount_topic
  FROM cell JOIN a_source USING (source) JOIN a_lang USING (lang) JOIN a_topic USING (topic)
  UNION ALL
  SELECT step + 1, source, lang, topic, everything, bound, weight, before,
    (step + 1) % {steps} = 0 AND max(abs(least(bound, weight) - before) / everything) OVER () <= {SETTLED}, amount_source, amount_lang, amount_topic
  FROM (
    SELECT * REPLACE (weight * greatest(0, max(scale) OVER (PARTITION BY margin)) AS weight, CASE WHEN step % {steps} = {steps - 3} THEN least(bound, weight) ELSE before END AS before)
    FROM (
      SELECT *, {by} AS margin, ({amount} - sum(bound) OVER (PARTITION BY {by}) + sum(bound) OVER b) / sum(weight) OVER b AS scale
      FROM fit WHERE NOT settled AND step < {3 * ROUNDS}
      WINDOW b AS (PARTITION BY {by} ORDER BY bound / weight DESC, {ties} ROWS UNBOUNDED PRECEDING)
    )
  )
),
chance AS (SELECT source, lang, topic, round(least(1, least(bound, weight) / bound), 9) AS probability FROM fit WHERE settled OR step = {3 * ROUNDS})
SELECT doc_id, source, lang, topic, tokens AS n_tokens, probability,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < probability AS sampled
FROM typed JOIN chance USING (source, lang, topic)
"""

"""Temperature mixing of sources, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import written

#: Bisection steps that one pass over the source totals settles, and passes.
STEPS, PASSES = 5, 4
#: Tokens of a block; beyond so many blocks, a source's blocks grow in number and in size with the square root of its tokens.
BLOCK_TOKENS, MAX_BLOCKS = 1 << 18, 1 << 16


def words(text: Column) -> Column:
    """Tokens counted natively: runs of characters other than space, tab and line ends; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def exponent(totals: DataFrame, budget: int, max_repeat: float | None = None, entropy: float | None = None) -> float:
    """Bisect the exponent of token shares on [0, 1], to 1 part in 2**20.

    ``totals`` has one row a source with ``tokens`` > 0. With ``max_repeat``: the
    smallest exponent at which no source is repeated more often than that, or 1 if
    none is enough. With ``entropy``, a share of the largest possible: the largest
    exponent that keeps it, or 0 if none does. With both, the larger of the two: the limit
    comes first. Each pass over the totals evaluates all midpoints
    that five bisection steps could visit, as plain aggregates.
    """
    if max_repeat is None and entropy is None:
        raise ValueError("give max_repeat or entropy")
    if max_repeat is not None and entropy is not None:
        return max(exponent(totals, budget, max_repeat), exponent(totals, budget, entropy=entropy))
    whole = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not whole[0]:
        return 1.0
    total, sources = int(whole[0]), int(whole[1])
    share = F.col("tokens") / F.lit(float(total))

    def meets(points: list[float]) -> list[bool]:
        norm = [F.sum(F.pow(share, F.lit(a))) for a in points]
        if max_repeat is not None:
            told = [F.max(F.pow(share, F.lit(a - 1))) * F.lit(float(budget)) / (z * F.lit(float(total))) <= F.lit(max_repeat) for a, z in zip(points, norm, strict=True)]
        else:
            told = [F.log(z) - F.lit(a) * F.sum(F.pow(share, F.lit(a)) * F.log(share)) / z < F.lit(entropy) * F.log(F.lit(float(sources))) for a, z in zip(points, norm, strict=True)]
        return list(totals.agg(*[x.alias(f"m{i}") for i, x in enumerate(told)]).first())

    # meets() is false below some exponent and true from there on
    ends = meets([0.0, 1.0])
    if ends[0] or not ends[1]:
        return (0.0 if ends[0] else 1.0)
    low, high, parts = 0.0, 1.0, 1 << STEPS
    for _ in range(PASSES):
        points = [low + (high - low) * i / parts for i in range(1, parts)]
        k = sum(not x for x in meets(points))
        low, high = low + (high - low) * k / parts, low + (high - low) * (k + 1) / parts
    return high if max_repeat is not None else low


def mix(df: DataFrame, budget: int | None = None, max_repeat: float | None = None, entropy: float | None = None, keep: list[str] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """Realise source weights as budgeted permutations: one row for every time a document is taken.

    Weights are token shares to the power found by ``exponent``, normalised. A
    source's budget is its weight of ``budget`` tokens (default: as many as there
    are). It is filled by passes; each takes the source's blocks in a new
    pseudo-random order and, in a block, documents in a fixed pseudo-random one.
    Whole passes take every document; the last takes documents while they fit, so
    it stays within the budget by less than one document. Returns ``id_col``, the
    ``keep`` columns, then mix_source (null for null), pass, block, tokens,
    mix_start (tokens before it in its source's stream), weight and exponent.

    A null source is a source of its own; a null text has no tokens. Documents
    without tokens cost nothing; a source of only such is taken once. An ``entropy`` alone may repeat
    a small source any number of times, a row each time; ``max_repeat`` with it bounds that. Rows that
    repeat an id are separate documents. An empty table gives no rows. Kept
    columns pass through under their own names; inner names start with ``_``, which
    kept names must not. A kept column named like a new one gives way to it.

    The text is read twice: for narrow counts, which are written, and for kept
    columns, which are shuffled once, by block. Blocks split a hot source; only
    the table of sources is aggregated whole.
    """
    made_here = {id_col, "mix_source", "pass", "block", "tokens", "mix_start", "weight", "exponent"}
    keep = [c for c in keep or [] if c not in made_here]
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    made = {"_s": key, "_mark": mark, "_tokens": words(F.col(text_col))}
    narrow = written(df.select(F.col(id_col), *[c.alias(k) for k, c in made.items()]), "counts")

    sources = written(narrow.groupBy("_s").agg(F.sum("_tokens").alias("tokens")), "sources")
    full = sources.where("tokens > 0")
    total = int(sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    budget = total if budget is None else budget
    power = exponent(full, budget, max_repeat, entropy)
    raw = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(power))
    norm = full.agg(F.sum(raw)).first()[0] or 1.0
    plan = sources.select("_s", "tokens", F.when(F.col("tokens") > 0, raw / F.lit(norm)).otherwise(0.0).alias("weight"))
    plan = plan.withColumn("_budget", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(0.5)).cast("long"))
    full_blocks = F.col("tokens") / F.lit(float(BLOCK_TOKENS))
    plan = plan.select(
        "_s", "weight", F.col("tokens").alias("_all"),
        F.when(F.col("tokens") > 0, F.expr("_budget div greatest(tokens, 1)")).otherwise(1).alias("_whole"),
        F.when(F.col("tokens") > 0, F.expr("_budget % greatest(tokens, 1)")).otherwise(0).alias("_rest"),
        F.greatest(F.lit(1), F.ceil(F.least(full_blocks, F.sqrt(full_blocks * F.lit(float(MAX_BLOCKS)))))).cast("long").alias("_blocks"),
    )

    block = F.pmod(F.conv(F.substring("_mark", 1, 12), 16, 10).cast("long"), F.col("_blocks"))
    sized = narrow.join(plan, "_s").withColumn("block", block).groupBy("_s", "block").agg(F.sum("_tokens").alias("_size"))
    passes = sized.join(plan, "_s").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole"))))
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), "_s", "pass", "block").cast("binary"))
    before = Window.partitionBy("_s", "pass").orderBy("_turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    passes = passes.withColumn("_turn", turn).withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    left = F.when(F.col("pass") < F.col("_whole"), F.col("_size")).otherwise(F.col("_rest") - F.col("_base"))
    runs = passes.withColumn("_left", left).where((F.col("pass") < F.col("_whole")) | (F.col("_left") > 0))
    runs = runs.groupBy("_s", "block", "weight").agg(F.collect_list(F.struct("pass", (F.col("_base") + F.col("pass") * F.col("_all")).alias("_base"), "_left")).alias("_runs"))

    rows = df.select(F.col(id_col), *keep, *[c.alias(k) for k, c in made.items()]) if keep else narrow
    order = Window.partitionBy("_s", "block").orderBy("_mark", id_col, "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(plan.select("_s", "_blocks"), "_s").withColumn("block", block)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_tokens").over(order), F.lit(0)))
    taken = rows.join(runs, ["_s", "block"]).select("*", F.inline("_runs")).where(F.col("_in") + F.col("_tokens") <= F.col("_left"))
    return taken.select(
        id_col, *keep, F.when(F.col("_s") != "-", F.expr("substring(_s, 2)")).alias("mix_source"), F.col("pass").cast("int").alias("pass"), "block",
        F.col("_tokens").alias("tokens"), (F.col("_base") + F.col("_in")).alias("mix_start"), "weight", F.lit(power).alias("exponent"),
    )


#: Production parameters of the query and of the pipeline's stage.
MAX_REPEAT = 1.25


def op1(spark, sf_dir: str) -> DataFrame:
    """Mix all documents to as many tokens as they hold, repeating no source more than 1.25 times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = mix(docs, max_repeat=MAX_REPEAT)
    return made.select("doc_id", F.col("mix_source").alias("source"), "pass", "block", "tokens", "mix_start", F.round("weight", 9).alias("weight"), "exponent")


OP1_SQL = rf"""
WITH RECURSIVE counts AS (
  SELECT doc_id, coalesce('=' || source, '-') AS s, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS mark,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)::BIGINT AS tokens FROM documents),
sources AS (SELECT s, sum(tokens)::BIGINT AS tokens FROM counts GROUP BY s),
whole AS (SELECT sum(tokens)::DOUBLE AS total FROM sources),
shares AS (SELECT tokens / total AS q, total FROM sources, whole WHERE tokens > 0),
ends AS (SELECT max(pow(q, -1.0)) / count(*) <= {MAX_REPEAT} AS at0, max(1.0) <= {MAX_REPEAT} AS at1 FROM shares),
bisect(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
               max(pow(q, (lo + hi) / 2 - 1)) * max(total) / (sum(pow(q, (lo + hi) / 2)) * max(total)) <= {MAX_REPEAT} AS ok
        FROM bisect, shares WHERE step < {STEPS * PASSES} GROUP BY step, lo, hi)),
power AS (SELECT CASE WHEN at0 THEN 0.0 WHEN NOT at1 THEN 1.0 ELSE (SELECT hi FROM bisect WHERE step = {STEPS * PASSES}) END AS a FROM ends),
weights AS (
  SELECT s, tokens, CASE WHEN tokens > 0 THEN pow(tokens / total, a) / (SELECT sum(pow(q, (SELECT a FROM power))) FROM shares) ELSE 0 END AS weight, total
  FROM sources, whole, power),
plan AS (
  SELECT s, tokens AS alltok, weight, CASE WHEN tokens > 0 THEN floor(weight * total + 0.5)::BIGINT // tokens ELSE 1 END AS whole,
         CASE WHEN tokens > 0 THEN floor(weight * total + 0.5)::BIGINT % tokens ELSE 0 END AS rest,
         greatest(1, ceil(least(tokens / {float(BLOCK_TOKENS)}, sqrt(tokens / {float(BLOCK_TOKENS)} * {float(MAX_BLOCKS)}))))::BIGINT AS blocks FROM weights),
placed AS (SELECT c.*, weight, (('0x' || substr(mark, 1, 12))::BIGINT) % blocks AS block FROM counts c JOIN plan USING (s)),
sized AS (SELECT s, block, sum(tokens)::BIGINT AS size FROM placed GROUP BY ALL),
passes AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY s, pass ORDER BY md5('17:' || s || ':' || pass || ':' || block), block
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
  FROM (SELECT s, block, size, alltok, whole, rest, unnest(range(whole + 1)) AS pass FROM sized JOIN plan USING (s))),
runs AS (SELECT s, block, pass, base + pass * alltok AS base, CASE WHEN pass < whole THEN size ELSE rest - base END AS room FROM passes
         WHERE pass < whole OR rest - base > 0),
ordered AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY s, block ORDER BY mark, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS inside
  FROM placed)
SELECT doc_id, CASE WHEN s <> '-' THEN substr(s, 2) END AS source, pass::INT AS pass, block, tokens, (base + inside)::BIGINT AS mix_start,
       round(weight, 9) AS weight, (SELECT a FROM power)::DOUBLE AS exponent
FROM ordered JOIN runs USING (s, block) WHERE inside + tokens <= room
"""

"""Compare batch budgets: python -m spanloom.sweep FILE --budgets 3000,6000 [--pattern REGEX] [--json OUT]."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import batching
from spanloom.operators.segments import source_id
from spanloom.operators.views import unit_warnings
from spanloom.plans.engine import extract
from spanloom.plans.providers import Provider
from spanloom.plans.settings import Profile, Settings
from spanloom.session import resolve_provider
from spanloom.sources.readers import read

DEFAULT = "3000,4000,6000,8000,12000"


def parse_budgets(raw: str) -> list[int]:
    found = [int(x) for x in raw.split(",") if x.strip()]
    if not found or min(found) <= 0:
        raise ValueError("budgets must be positive integers")
    return found


def sweep(blocks: DataFrame, budgets: list[int], pattern: str | None = None) -> DataFrame:
    """A summary of the plan for each budget, all documents together."""
    choices = F.explode(F.array(*[F.lit(b).cast("long") for b in budgets]))
    rows = batching.with_units(blocks, pattern).withColumn("budget", choices)
    return batching.summarize(batching.plan_units(rows, F.col("budget"), ("budget",)), "budget").orderBy("budget")


def sweep_live(blocks: DataFrame, budgets: list[int], profile: Profile, provider: Provider, section: str = "") -> list[dict]:
    """What an extraction under each budget comes to: calls, tokens, units, flagged ones, source ids, and whether one begins with ``section``."""
    rows = []
    for budget in budgets:  # a handful, each a whole extraction
        e = extract(blocks, profile, provider, Settings(target_input_tokens=budget))
        ids = source_id(F.transform("specs", lambda s: s["metadata"]))
        units = unit_warnings(e.units).withColumn("id", ids).agg(
            F.count(F.lit(1)).alias("n_units"), F.count_if(F.size("warnings") > 0).alias("n_flagged_units"), F.countDistinct("id").alias("n_source_ids"),
            F.coalesce(F.bool_or(F.col("id").startswith(section)), F.lit(False)).alias("has_section"),
        )
        calls = e.calls.agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
        rows.append({"budget": budget} | calls.first().asDict() | units.first().asDict())
    return rows


def main(argv: list[str] | None = None) -> list[dict]:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("file")
    parser.add_argument("--budgets", type=parse_budgets, default=parse_budgets(DEFAULT))
    parser.add_argument("--pattern")
    parser.add_argument("--json")
    parser.add_argument("--live", action="store_true", help="extract under each budget, with the provider that SPANLOOM_PROVIDER names")
    parser.add_argument("--section", default="", help="with --live: tell whether a source id begins with this")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    blocks = read(spark, args.file)
    if args.live:
        rows = sweep_live(blocks, args.budgets, Profile("sweep", boundary_pattern=args.pattern), resolve_provider(settings=Settings.of(spark)), args.section)
    else:
        rows = [r.asDict() for r in sweep(blocks, args.budgets, args.pattern).collect()]  # a row a budget
    columns = list(rows[0]) if rows else []
    for line in [columns, *[list(r.values()) for r in rows]]:
        print("".join(f"{x!s:>16}" for x in line))
    if args.json:
        Path(args.json).write_text(json.dumps(rows, indent=2))
    return rows


if __name__ == "__main__":
    main()

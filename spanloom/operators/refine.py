"""Second calls for units whose end was inferred or not found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windows(units: DataFrame, ends: DataFrame) -> DataFrame:
    """The span to look at again for each unit that needs it: to the next unit's start, or to the range's end for a last unit with an end.

    ``units`` has doc_id, k, start, end and the two flags; ``ends`` has doc_id and
    range_end. Empty windows are left out.
    """
    order = Window.partitionBy("doc_id").orderBy("k")
    rows = units.withColumn("_next", F.lead("start").over(order)).join(ends, "doc_id")
    last = F.when(F.col("end") >= 0, F.col("range_end"))
    rows = rows.where("end_inferred_from_next_start OR end_quote_unresolved").withColumn("span_end", F.coalesce("_next", last))
    return rows.withColumn("span_start", F.col("start")).where("span_start >= 0 AND span_end > span_start").drop("_next")


def merge(units: DataFrame, refined: DataFrame) -> DataFrame:
    """Units with a second call's end where it is acceptable.

    ``refined`` has doc_id, k, span_end and the units found in the window as rows
    (new_start, new_end, new_end_quote, new_end_resolved and what else is to be kept). Accepted is a single
    unit with the same start, a resolved end, an end quote, and an end behind the
    start and within the window. Other new columns stay, null for units that were not accepted.
    """
    inner = ["span_end", "new_start", "new_end", "new_end_quote", "new_end_resolved"]
    more = [c for c in refined.columns if c not in ("doc_id", "k", *inner)]
    firsts = [F.first(c).alias(c) for c in (*inner, *more)]
    alone = refined.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"), *firsts)
    joined = units.join(alone, ["doc_id", "k"], "left")
    fine = (F.col("n") == 1) & (F.col("new_start") == F.col("start")) & F.col("new_end_resolved")
    fine = fine & (F.coalesce("new_end_quote", F.lit("")) != "") & (F.col("new_end") > F.col("start")) & (F.col("new_end") <= F.col("span_end"))
    fine = F.coalesce(fine, F.lit(False))
    pick = lambda new, old: F.when(fine, new).otherwise(F.col(old))
    return joined.withColumns({
        "end": pick(F.col("new_end"), "end"), "end_quote": pick(F.col("new_end_quote"), "end_quote"),
        "end_inferred_from_next_start": pick(F.lit(False), "end_inferred_from_next_start"), "end_quote_unresolved": pick(F.lit(False), "end_quote_unresolved"),
        "refined": fine, **{c: F.when(fine, F.col(c)) for c in more},
    }).drop("n", *inner)

"""A small recorded corpus that reaches every branch of the resolve and stitch kernels.

Each case is a document of blocks and its answered batches: (first block, last block,
payload). Payloads are what a model sent; nothing here is computed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.blocks import with_offsets
from spanloom.plans.providers import RuleBased, call


def item(status: str = "complete", start: str | None = None, end: str | None = None, segments: list[dict] | None = None) -> dict:
    made = {"status": status, "start_quote": start, "end_quote": end}
    return made if segments is None else {"status": status, "segments": segments}


def segment(role: str, start: str | None = None, end: str | None = None, before: str | None = None, after: str | None = None, **metadata: object) -> dict:
    made = {"role": role, "start_quote": start, "end_quote": end, "end_before_quote": before, "start_after_quote": after}
    return made | ({"metadata": metadata} if metadata else {})


class Limited(RuleBased):
    """Finds batches too long that hold a dense block and another, as a model with little room for its answer would."""

    def propose(self, prompt: str, text: str, blocks: list[dict]) -> dict:
        made = super().propose(prompt, text, blocks)
        return made | {"stop_reason": "max_tokens", "payload_json": "{}"} if "dense" in text and len(blocks) > 1 else made


def overflow_blocks(spark: SparkSession) -> DataFrame:
    """Thirty blocks of equal length, of which the eighth is dense."""
    rows = [("d", 1, i, f"block {i:02d} {'is dense' if i == 7 else 'is plain'} text and it ends here {i:02d}", None, str(i)) for i in range(30)]
    return with_offsets(spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, role string, label string"))


class Closing:
    """Asked about one unit's window, quotes its first two and its last two words."""

    def propose(self, prompt: str, text: str, blocks: list[dict]) -> dict:
        words = text.split()
        return call({"requirements": [item(start=" ".join(words[:2]), end=" ".join(words[-2:]))]})


BETA = "Beta stands alone in one block."
#: name: blocks with their pages, batches, and how a batch failed ("failed", "overflowed") by its place
CASES: dict[str, tuple[list[tuple[int, str]], list[tuple[int, int, object]], dict[int, str]]] = {
    "ambiguous": (
        [(1, "one two three four fifth words and more. Then one two three four fifth words again.")],
        [(0, 0, [item(start="one two three four fifth XX", end="and more."), item(start="Then one two three", end="again.")])],
        {},
    ),
    "clipped": (
        [(1, "Head text goes here. Shared middle part. Tail text ends.")],
        [(0, 0, [item(segments=[segment("requirement", "Head text", "Shared middle part."), segment("context", "Shared middle", "Tail text ends.")])])],
        {},
    ),
    "cross": (
        [(1, "Alpha begins with these words and"), (2, "goes on for a while until alpha ends here."), (2, BETA)],
        [(0, 0, [item("truncated_at_end", "Alpha begins")]), (1, 2, [item("truncated_at_start", None, "alpha ends here."), item(start="Beta stands", end="one block.")])],
        {},
    ),
    "exclusive": (
        [(3, "Heading One Body of one, up to the next. Heading Two Body of two."), (5, "Question: is it so? Yes.")],
        [(0, 1, [
            item(segments=[segment("requirement", after="Heading One", before="Heading Two", req_id="1")]),
            item(segments=[segment("requirement", "Heading Two", "Body of two.", req_id=2, subcategory_id=" b "), segment("questionnaire", "Question:", "so?")]),
        ])],
        {},
    ),
    "fallback": (
        [(1, "zero one two three four fifth and more words here. The end of it comes now.")],
        [(0, 0, [item(start="one two three four fifth XX", end="XX the end of it comes now.")])],
        {},
    ),
    "flushed": ([(1, "Open text that has no end"), (1, "and goes on to the last block.")], [(0, 1, [item("truncated_at_end", "Open text")])], {}),
    "gone": (
        [(1, "First batch fails here."), (1, "Second batch is too long."), (1, "Third batch is fine.")],
        [(0, 0, []), (1, 1, []), (2, 2, [item(start="Third batch", end="fine.")])],
        {0: "failed", 1: "overflowed"},
    ),
    "inferred": (
        [(1, "First begins here and has no end quote. Second begins here with a wrong one. Third begins and ends.")],
        [(0, 0, [item(start="First begins"), item(start="Second begins", end="never said"), item(start="Third begins", end="and ends.")])],
        {},
    ),
    "interrupted": (
        [(1, "Alpha begins with these words and"), (1, "never ends. Beta is whole.")],
        [(0, 0, [item("truncated_at_end", "Alpha begins")]), (1, 1, [item(start="Beta is", end="whole.")])],
        {},
    ),
    "malformed": (
        [(1, "Only this is fine.")],
        [(0, 0, [7, {"status": "complete"}, {"segments": [1]}, item(start="Only this", end="fine."), {"segments": [], "end_quote": None}])],
        {},
    ),
    "multi-open": (
        [(1, "Part one is here. Part two begins"), (1, "but another thing starts. It ends.")],
        [
            (0, 0, [item("truncated_at_end", segments=[segment("requirement", "Part one", "is here."), segment("context", "Part two")])]),
            (1, 1, [item(start="another thing", end="It ends.")]),
        ],
        {},
    ),
    "orphan": ([(1, "tail of what came before. Next."), (1, BETA)], [(0, 1, [item("truncated_at_start", None, "came before."), item(start="Beta stands", end="one block.")])], {}),
    "text": ([(1, "A list sent as text.")], [(0, 0, json.dumps([item(start="A list", end="as text.")])), ], {}),
    "three": (
        [(1, "Alpha begins and"), (1, "runs through the middle"), (1, "to where alpha ends. Over.")],
        [(0, 0, [item("truncated_at_end", "Alpha begins")]), (1, 1, [item("truncated_at_start")]), (2, 2, [item("truncated_at_start", None, "alpha ends.")])],
        {},
    ),
    "untrue": (
        [(1, "Curly “quotes” – and   wide\tspace stay as they are.")],
        [(0, 0, [item(start='"quotes" - and wide', end="they are."), item(start="nowhere to be found at all in it", end="are.")])],
        {},
    ),
}


def recorded_blocks(spark: SparkSession) -> DataFrame:
    """Blocks of all cases; the case ``exclusive`` was read from page 2 to page 6, of which three kept no block."""
    rows = [(name, page, i, text, 2 if name == "exclusive" else 1, 6 if name == "exclusive" else 2) for name, (blocks, _, _) in CASES.items() for i, (page, text) in enumerate(blocks)]
    made = spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, first_page int, last_page int")
    return with_offsets(made)


def recorded_calls(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """The answered batches of all cases, as a call's columns."""
    rows = []
    for name, (_, batches, bad) in CASES.items():
        for n, (first, last, payload) in enumerate(batches):
            attempts = [{"model": "m", "attempt_no": 1, "duration_s": 0.5, "outcome": "api_error" if n in bad else "ok", "error_message": None}]
            stop = "max_tokens" if bad.get(n) == "overflowed" else "tool_use"
            rows.append((name, n + 1, first, last, json.dumps({"requirements": payload}), stop, bad.get(n) == "failed", bad.get(n) == "overflowed", json.dumps(attempts)))
    fields = "doc_id string, chunk_id long, first_block long, last_block long, payload_json string, stop_reason string, failed boolean, overflowed boolean, attempts string"
    calls = spark.createDataFrame(rows, fields)
    at = blocks.select("doc_id", "block_idx", "page", "char_start", "char_end")
    low = at.select("doc_id", F.col("block_idx").alias("first_block"), "char_start", F.col("page").alias("page_start"))
    high = at.select("doc_id", F.col("block_idx").alias("last_block"), "char_end", F.col("page").alias("page_end"))
    calls = calls.join(low, ["doc_id", "first_block"]).join(high, ["doc_id", "last_block"])
    plain = {"model_used": F.lit("m"), "input_tokens": F.lit(10).cast("long"), "output_tokens": F.lit(5).cast("long"), "response_time_s": F.lit(0.25)}
    plain |= {f"cache_{k}_tokens": F.lit(0).cast("long") for k in ("creation", "read")} | {"chunk_hash": F.substring(F.sha2("payload_json", 256), 1, 16)}
    return calls.withColumns(plain | {"est_input_tokens": F.floor((F.col("char_end") - F.col("char_start")) / 4) + 1})


def quoting_client():
    """A made-up service's client: one unit of the text it is sent, from its first words to its last."""

    def create(**request):
        words = request["messages"][-1]["content"].split()
        unit = item(segments=[segment("requirement", " ".join(words[:4]), " ".join(words[-4:]), req_id="7")])
        return {"content": [{"type": "tool_use", "input": {"requirements": [unit]}}], "usage": {"input_tokens": 3, "output_tokens": 4}, "stop_reason": "tool_use"}

    return create

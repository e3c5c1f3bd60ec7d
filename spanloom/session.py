"""Small façade: one document at hand, an extraction as SQL views, and provider choice."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import blocks as B
from spanloom.operators import views
from spanloom.plans.backends import ChatService, MessageService, Named
from spanloom.plans.engine import Extraction
from spanloom.plans.providers import Chain, Provider, Recorded, RuleBased
from spanloom.plans.settings import Settings
from spanloom.sources.readers import read as read_blocks


class Document:
    """One document's blocks, with lookups on the driver for notebooks and tests."""

    def __init__(self, blocks: DataFrame, path: str = "", parser: str = "text"):
        self.table, self.path, self.parser = blocks, path, parser
        row = B.documents(blocks).first()
        self.full_text, self.doc_hash, self._row = (row.full_text, row.doc_hash, row) if row else ("", "", None)

    def text_in_range(self, start: int, end: int) -> str:
        return self.full_text[start:end]

    def block_at_offset(self, offset: int):
        return self.table.where((F.col("char_start") <= offset) & (F.col("char_end") > offset)).first()

    def locate(self, offset: int) -> tuple[int, int] | None:
        """Page and block number, or None between blocks."""
        block = self.block_at_offset(offset)
        return (block.page, block.block_idx) if block else None

    def summary(self) -> dict:
        if self._row is None:
            return {"path": self.path, "hash": "", "parser": self.parser, "n_blocks": 0, "n_chars": 0, "pages_processed": ""}
        r = self._row
        return {"path": self.path, "hash": self.doc_hash[:12], "parser": self.parser, "n_blocks": r.n_blocks,
            "n_chars": len(self.full_text), "pages_processed": f"{r.start_page}-{r.end_page} of {r.end_page}"}

    def blocks(self, include_full_text: bool = False) -> str | None:
        """The blocks artifact as JSON text."""
        row = views.blocks_json(self.table, B.documents(self.table), "text" if self.parser == "text" else "pdf", include_full_text).first()
        return row.json if row else None


def read(spark: SparkSession, path: str, **options) -> Document:
    return Document(read_blocks(spark, path, **options), path, "text" if path.lower().endswith(".txt") else "pdf")


def tabular(e: Extraction) -> dict[str, DataFrame]:
    """The four flat views by name."""
    return {"segments": views.segments_view(e.units, e.blocks), "units": views.units_view(e.units, e.docs), "quotes": views.quotes_view(e.units), "calls": views.calls_view(e.calls)}


def register(e: Extraction, prefix: str = "") -> list[str]:
    """Make the views and base tables available to SQL as temporary views; returns their names."""
    tables = tabular(e) | {"docs": e.docs, "blocks": e.blocks}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{x}" for x in tables]


def find_unit(e: Extraction, which: int | str) -> Row:
    """The record of the first unit with that sequence number or unit id; KeyError if there is none."""
    row = views.inspect(e.units, e.calls, which, e.docs).orderBy("doc_id").first()
    if row is None:
        raise KeyError(which)
    return row


def resolve_provider(name: str | None = None, payloads: dict[str, str] | None = None, settings: Settings | None = None) -> Provider:
    """The provider by name, else by SPANLOOM_PROVIDER, else recorded payloads if there are any, else rule-based.

    ``messages`` and ``chat`` are services; SPANLOOM_CLIENT names the function that makes their client, as
    ``package.module:function``, which is imported where it is called. Their models, retries and limits are those of ``settings``.
    """
    name = (name or os.environ.get("SPANLOOM_PROVIDER") or "auto").strip().lower()
    if name == "recorded" or (name == "auto" and payloads):
        if not payloads:
            raise ValueError("the recorded provider needs payloads")
        return Recorded(payloads)
    if name in ("messages", "chat"):
        named = os.environ.get("SPANLOOM_CLIENT", "")
        if ":" not in named:
            raise ValueError("set SPANLOOM_CLIENT to package.module:function")
        settings = settings or Settings()
        if name == "chat":  # one deployment, no other models
            settings = replace(settings, fallback_models="")
        return Chain((MessageService if name == "messages" else ChatService)(Named(named)), settings)
    if name in ("auto", "rule-based"):
        return RuleBased()
    raise ValueError(f"unknown provider: {name}")

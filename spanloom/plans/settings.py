"""Settings, from Spark's configuration with the environment as fallback."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession

from spanloom.functions.text import input_token_budget

CONTEXT_WINDOW = 200_000


@dataclass(frozen=True)
class Settings:
    """Names in Spark are ``spark.spanloom.<field>``, in the environment ``SPANLOOM_<FIELD>``."""

    model: str = "recorded"
    fallback_models: str = ""
    max_tokens: int = 8000
    temperature: float = 0.0
    max_retries: int = 3
    retry_wait_s: float = 10.0
    target_input_tokens: int = 12000
    min_input_tokens: int = 600
    shrink_factor: float = 0.5
    max_consecutive_shrinks: int = 4
    max_iterations: int = 500
    keep_lone_ends: bool = True
    drop_margin_blocks: bool = True
    drop_patterns: str = ""  # one regular expression a line
    dynamic_budget: bool = False  # the budget is what the model's window leaves, at most target_input_tokens if that is above 0
    context_windows: str = ""  # model=tokens, separated by commas
    call_pause_s: float = 0.0  # between two calls of one task
    calls_in_flight: int = 1  # of one task
    tokens_per_s: float = 0.0  # of one task's prompts and texts, together; 0: no limit
    call_store: str = ""  # a folder that keeps answers beyond the job

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(f"spark.spanloom.{f.name}", None) or os.environ.get(f"SPANLOOM_{f.name.upper()}")
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.strip().lower() not in ("0", "false", "no") if kind is bool else kind(raw)
        return cls(**found)

    def context_window(self, model: str | None = None) -> int:
        """Tokens that a model's window holds: by the table in ``context_windows``, else 200,000."""
        pairs = (x.split("=", 1) for x in self.context_windows.split(",") if "=" in x)
        return {k.strip(): int(v) for k, v in pairs}.get(model or self.model, CONTEXT_WINDOW)

    def budget(self, prompt: str) -> int:
        """Tokens of a batch."""
        if not self.dynamic_budget:
            return self.target_input_tokens
        return input_token_budget(len(prompt), self.context_window(), output=self.max_tokens, cap=self.target_input_tokens or None)

    def patterns(self) -> tuple[str, ...]:
        return tuple(x for x in self.drop_patterns.split("\n") if x.strip())

    def models(self) -> list[str]:
        """The model and its fallbacks, each once."""
        return list(dict.fromkeys(x.strip() for x in (self.model, *self.fallback_models.split(",")) if x.strip()))


@dataclass(frozen=True)
class Profile:
    """What to look for: the prompt's own part, the pattern of headings and the roles in use."""

    name: str
    prompt: str = ""
    boundary_pattern: str | None = None
    roles: tuple[str, ...] = ("requirement",)

    @classmethod
    def from_file(cls, path: str | Path, boundary_pattern: str | None = None, roles: tuple[str, ...] = ("requirement",)) -> Profile:
        """A profile whose prompt is a text file, named after it."""
        return cls(Path(path).stem, read_prompt(path), boundary_pattern, roles)


def read_prompt(path: str | Path) -> str:
    """A prompt from a UTF-8 file, stripped; a missing or empty file is an error."""
    text = Path(path).read_text(encoding="utf-8").strip()
    if not text:
        raise ValueError(f"empty prompt file: {path}")
    return text


CONTRACT = """Return only short verbatim quotes that mark where each unit begins and ends, never its text.
Quote exactly, and choose quotes that occur once. Keep a source's own id in metadata. Give segments in
order, without overlaps; text between them is left out. Mark only the last unit as truncated_at_end.
An empty list is a valid answer."""
REFINEMENT = """Return exactly one item for the given window. Its end quote is required and its status is complete."""


def system_prompt(profile: Profile, refining: bool = False) -> str:
    return "\n\n---\n\n".join(x for x in (CONTRACT, profile.prompt.strip(), REFINEMENT if refining else "") if x)

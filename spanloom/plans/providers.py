"""Providers of model payloads: recorded, rule-based, or any callable with retries and fallbacks."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from spanloom.operators.resolve import Numbering
from spanloom.plans.settings import Settings

# HTTP states after which a call is worth repeating.
RETRYABLE = frozenset({408, 409, 429, 500, 502, 503, 504, 529})
QUOTE_WORDS = 6


class Provider(Protocol):
    """Called once a batch, on the executors; must be picklable. Returns a call's columns."""

    def propose(self, prompt: str, text: str, blocks: list[dict]) -> dict: ...


def call(payload: dict | str, model: str = "recorded", input_tokens: int = 0, output_tokens: int = 0, stop_reason: str = "tool_use", attempts: list[dict] | None = None) -> dict:
    raw = payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
    return {"payload_json": raw, "model_used": model, "input_tokens": input_tokens, "output_tokens": output_tokens,
        "cache_creation_tokens": 0, "cache_read_tokens": 0, "stop_reason": stop_reason, "response_time_s": 0.0,
        "attempts": json.dumps(attempts or [])}


@dataclass
class RuleBased:
    """One item a block, quoting its first and last words, half of a short block each; offline and deterministic."""

    words: int = QUOTE_WORDS

    def propose(self, prompt: str, text: str, blocks: list[dict]) -> dict:
        items, numbers = [], Numbering([b["text"] for b in blocks])
        for b, span in zip(blocks, numbers.spans, strict=True):
            words = b["text"].split(" ")
            items.append({"status": "complete", "segments": [numbers.segment({"start_quote": " ".join(words[: min(self.words,
                len(words) - len(words) // 2)]), "end_quote": " ".join(words[-min(self.words, len(words) // 2) :]) if len(words) > 1 else None,
                "role": b.get("role"), "metadata": {"req_id": b.get("label")}}, *span)]})
        return call({"requirements": items}, "rule-based", len(text) // 4 + 1, 20 * len(items))


@dataclass
class Recorded:
    """Payloads recorded under the hash of the batch's text; what is not recorded is an api_error.

    The payloads travel with the tasks, so this is for notebooks and tests; join a table of
    recorded calls with ``assemble`` where there are many.
    """

    payloads: dict[str, str]

    def propose(self, prompt: str, text: str, blocks: list[dict]) -> dict:
        key = hashlib.sha256(text.encode()).hexdigest()[:16]
        if key not in self.payloads:
            raise KeyError(f"no payload for {key}")
        return call(self.payloads[key])


def stop_reason(finish: str | None, has_calls: bool) -> str:
    """One vocabulary for why a model stopped."""
    if finish == "length":
        return "max_tokens"
    return "tool_use" if has_calls or finish == "tool_calls" else finish or ""


def arguments(raw: object) -> dict:
    """A tool call's arguments: an object, or JSON text of one."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise RuntimeError(f"arguments are no JSON: {e}") from e
    if not isinstance(raw, dict):
        raise RuntimeError("arguments are no object")
    return raw


class CallError(Exception):
    def __init__(self, message: str, status: int | None = None, connection: bool = False, missing_model: bool = False):
        super().__init__(message)
        self.status, self.retryable = status, connection or status in RETRYABLE
        self.outcome = "not_found" if missing_model else "connection_error" if connection else "api_error"


@dataclass
class Chain:
    """Calls ``send(model, prompt, text, max_tokens=, temperature=)`` for each model in turn, again after retryable errors."""

    send: Callable[..., dict]
    settings: Settings

    def propose(self, prompt: str, text: str, blocks: list[dict]) -> dict:
        attempts = []
        options = {"max_tokens": self.settings.max_tokens, "temperature": self.settings.temperature}
        for model in self.settings.models():
            for n in range(1, self.settings.max_retries + 1):
                began = time.monotonic()
                try:
                    made = self.send(model, prompt, text, **options)
                except CallError as e:
                    attempts.append({"model": model, "attempt_no": n, "duration_s": round(time.monotonic() - began, 3), "outcome": e.outcome, "error_message": str(e)[:200]})
                    if not e.retryable or e.outcome == "not_found":
                        break
                    if n < self.settings.max_retries:
                        time.sleep(self.settings.retry_wait_s)
                    continue
                attempts.append({"model": model, "attempt_no": n, "duration_s": round(time.monotonic() - began, 3), "outcome": "ok", "error_message": None})
                return call({}, model) | made | {"model_used": model, "attempts": json.dumps(attempts)}
        raise RuntimeError(f"all models failed: {attempts[-1]['error_message'] if attempts else 'no model'}")

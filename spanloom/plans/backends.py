"""Model services behind a forced tool call, by clients that the caller brings; no SDK is imported here.

A client is made once in each worker, by a factory that reads its secrets there, and is
called with plain keyword arguments. Its answer is a mapping.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import import_module

from spanloom.operators.payloads import SCHEMA
from spanloom.plans.providers import CallError, arguments, call, stop_reason

Client = Callable[..., Mapping]


@dataclass(frozen=True)
class Tool:
    """The tool that a model must call, and what it is asked to send."""

    name: str = "record_units"
    description: str = "Record the units found in the text, as quotes that mark their ends."
    schema: str = field(default_factory=lambda: json.dumps(SCHEMA))


@dataclass(frozen=True)
class Named:
    """A factory by its name, ``package.module:function``; imported in the worker that calls it."""

    name: str

    def __call__(self) -> Client:
        module, function = self.name.split(":", 1)
        return getattr(import_module(module), function)()


@lru_cache(maxsize=8)
def client(factory: Callable[[], Client]) -> Client:
    """The worker's client of a factory; made at its first call."""
    return factory()


@dataclass(frozen=True)
class MessageService:
    """Services that take a system text and messages, and answer with content parts."""

    factory: Callable[[], Client]
    tool: Tool = Tool()

    def __call__(self, model: str, prompt: str, text: str, max_tokens: int = 8000, temperature: float = 0.0) -> dict:
        answer = client(self.factory)(
            model=model, max_tokens=max_tokens, temperature=temperature, system=prompt, messages=[{"role": "user", "content": text}],
            tools=[{"name": self.tool.name, "description": self.tool.description, "input_schema": json.loads(self.tool.schema)}],
            tool_choice={"type": "tool", "name": self.tool.name},
        )
        parts = [x for x in answer.get("content", []) if x.get("type") == "tool_use"]
        payload = parts[0].get("input") if parts else {}
        used = answer.get("usage") or {}
        made = call(payload if isinstance(payload, dict) else {}, model, used.get("input_tokens") or 0, used.get("output_tokens") or 0, answer.get("stop_reason") or "")
        cached = {f"cache_{k}_tokens": used.get(f"cache_{k}_input_tokens") or 0 for k in ("creation", "read")}
        return made | cached


@dataclass(frozen=True)
class ChatService:
    """Services that take chat messages and answer with choices. There is one deployment, so no chain of models.

    Some take the limit of tokens under another name: a refusal that names the parameter is answered by a second try.
    """

    factory: Callable[[], Client]
    tool: Tool = Tool()

    def __call__(self, model: str, prompt: str, text: str, max_tokens: int = 8000, temperature: float = 0.0) -> dict:
        function = {"name": self.tool.name, "description": self.tool.description, "parameters": json.loads(self.tool.schema)}
        request = {
            "model": model, "temperature": temperature, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": text}],
            "tools": [{"type": "function", "function": function}], "tool_choice": {"type": "function", "function": {"name": self.tool.name}},
        }
        try:
            answer = client(self.factory)(**request, max_tokens=max_tokens)
        except CallError as e:
            if e.status != 400 or "max_tokens" not in str(e):
                raise
            answer = client(self.factory)(**request, max_completion_tokens=max_tokens)
        choice = answer["choices"][0]
        calls = (choice.get("message") or {}).get("tool_calls") or []
        payload = arguments(calls[0]["function"]["arguments"]) if calls else {}
        used = answer.get("usage") or {}
        return call(payload, model, used.get("prompt_tokens") or 0, used.get("completion_tokens") or 0, stop_reason(choice.get("finish_reason"), bool(calls)))

"""Model payloads: their schema, and items made from whatever a model sent."""

from __future__ import annotations

import json

# The fields of a payload. What a model is asked to send: quotes of the ends, never body text.
SCHEMA = {
    "type": "object",
    "properties": {
        "requirements": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {
                    "status": {"type": "string", "enum": ["complete", "truncated_at_end", "truncated_at_start"]},
                    "start_quote": {"type": ["string", "null"]},
                    "end_quote": {"type": ["string", "null"]},
                    "start_nth": {"type": ["integer", "null"]},
                    "end_nth": {"type": ["integer", "null"]},
                    "segments": {
                        "type": "array",
                        "items": {
                            "type": "object",
                            "properties": {
                                "start_quote": {"type": ["string", "null"]},
                                "end_quote": {"type": ["string", "null"]},
                                "end_before_quote": {"type": ["string", "null"]},
                                "start_after_quote": {"type": ["string", "null"]},
                                "start_nth": {"type": ["integer", "null"]},
                                "end_nth": {"type": ["integer", "null"]},
                                "role": {"type": ["string", "null"]},
                                "metadata": {"type": ["object", "null"]},
                            },
                        },
                    },
                },
            },
        }
    },
    "required": ["requirements"],
}
FIELDS = ("start_quote", "end_quote", "end_before_quote", "start_after_quote")
#: Which place of a quote is meant, counted from the first that could be; optional.
NUMBERS = ("start_nth", "end_nth")


def renamed(item: object, names: dict[str, str] | None) -> object:
    """An item of a foreign payload under our field names; ``names`` maps ours to its own."""
    if not names or not isinstance(item, dict):
        return item
    ours = {v: k for k, v in names.items()}
    out = {ours.get(k, k): v for k, v in item.items()}
    if isinstance(out.get("segments"), list):
        out["segments"] = [{ours.get(k, k): v for k, v in s.items()} if isinstance(s, dict) else s for s in out["segments"]]
    return out


def role_of(value: object) -> str:
    return value.strip() if isinstance(value, str) and value.strip() else "requirement"


def spec(raw: dict) -> dict:
    """A segment's quotes, role and metadata, and those numbers of its quotes that were sent and are numbers from 1."""
    number = {k: raw[k] for k in NUMBERS if type(raw.get(k)) is int and raw[k] > 0}
    text = {k: raw.get(k) if isinstance(raw.get(k), str) else None for k in FIELDS}
    return text | {"role": role_of(raw.get("role")), "metadata": raw.get("metadata") if isinstance(raw.get("metadata"), dict) else None} | number


def specs_of(item: object) -> tuple[list[dict], str | None]:
    """An item's segment specs, or the reason why it is malformed.

    A non-empty list of segments wins over quotes on the item itself; a single
    segment that is no object spoils the item. An item that goes on from an earlier
    batch needs no quote.
    """
    if not isinstance(item, dict):
        return [], "not-a-dict"
    segments = item.get("segments")
    if isinstance(segments, list) and segments:
        if not all(isinstance(x, dict) for x in segments):
            return [], "invalid_segment_item"
        return [spec(x) for x in segments], None
    start, end = item.get("start_quote"), item.get("end_quote")
    if start is not None or end is not None or item.get("status") == "truncated_at_start":
        return [spec({k: item.get(k) for k in ("start_quote", "end_quote", *NUMBERS)})], None
    return [], "missing_quotes"


def items_of(payload: str | None) -> tuple[list[object], list[str]]:
    """The items of a payload, and reasons why it holds none that can be read.

    A list sent as JSON text is parsed; text that is no JSON is one item, which
    will lack quotes; JSON text of something else, and a value that is no list, is one malformed entry.
    """
    try:
        found = json.loads(payload) if payload else {}
    except ValueError:
        return [], ["not-json"]
    items = found.get("requirements", []) if isinstance(found, dict) else []
    if isinstance(items, str):
        try:
            items = json.loads(items)
        except ValueError:
            return [{"raw": items}], []
    return (items, []) if isinstance(items, list) else ([], ["not-a-list"])


def batch_status(n_units: int, n_verbatim: int, n_malformed: int, stop_reason: str | None) -> str:
    if n_malformed:
        return "json_error"
    if stop_reason == "max_tokens" and not n_units:
        return "overflow"
    if n_units and n_verbatim < n_units:
        return "verbatim_failure"
    return "ok" if n_units else "empty"

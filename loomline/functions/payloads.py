"""Reading dirty JSON payloads."""

from __future__ import annotations

import json


def _bare(text: str) -> str:
    """Without white space and byte-order marks at both ends, in whatever order they come."""
    while True:
        s = text.strip().strip("﻿")
        if s == text:
            return s
        text = s


def load(payload: str | None) -> tuple[bool, object]:
    """(readable, value). Readable: one complete JSON document after trimming and after undoing one wrapping as a JSON string."""
    if payload is None:
        return False, None
    try:
        value = json.loads(_bare(payload))
        if isinstance(value, str):
            value = json.loads(_bare(value))
        return True, value
    except (ValueError, RecursionError):
        return False, None


def text_of(value: object) -> str:
    """A leaf as text: strings as they are, null as '', anything else as JSON."""
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

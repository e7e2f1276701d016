"""Signed page cursors and response budgets; all of it runs on the driver over one page."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re

from strataseek.errors import InvalidCursor

PAYLOAD_BYTES = 30_720
CURSOR_CHARS = 4096


def canonical(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def _exact(v):
    """Floats as hexadecimal text, so that a key comes back bit for bit."""
    return {"f": v.hex()} if isinstance(v, float) else v


def _plain(v):
    return float.fromhex(v["f"]) if isinstance(v, dict) else v


def sign(key: bytes, scope: dict, last: tuple) -> str:
    """A cursor behind ``last``, good only for the same ``scope`` (endpoint, request, generation)."""
    body = canonical({"v": 1, "scope": hashlib.sha256(canonical(scope)).hexdigest(), "last": [_exact(x) for x in last]})
    pack = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return f"{pack(body)}.{pack(hmac.new(key, body, hashlib.sha256).digest())}"


def read(key: bytes, scope: dict, cursor: str) -> tuple:
    """The key in a cursor; raises InvalidCursor for anything but an untouched cursor of this scope."""
    try:
        if not isinstance(cursor, str) or len(cursor) > CURSOR_CHARS or not re.fullmatch(r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", cursor):
            raise ValueError("form")
        body, mark = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in cursor.split("."))
        if not hmac.compare_digest(mark, hmac.new(key, body, hashlib.sha256).digest()):
            raise ValueError("signature")
        value = json.loads(body)
        if value["v"] != 1 or value["scope"] != hashlib.sha256(canonical(scope)).hexdigest() or sign(key, scope, tuple(_plain(x) for x in value["last"])) != cursor:
            raise ValueError("scope")
        return tuple(_plain(x) for x in value["last"])
    except (ValueError, KeyError, TypeError, UnicodeError) as e:
        raise InvalidCursor(f"the cursor is broken or belongs to another request ({e})") from e


def pack_page(rows: list[dict], limit: int, base: dict, cursor_of, clip: str | None = None, budget: int = PAYLOAD_BYTES) -> dict:
    """As many whole rows as fit into the budget, with a cursor if more follow.

    ``rows`` may hold one row more than ``limit``. If not even the first row
    fits, its field ``clip`` is shortened until it does.
    """
    def build(items, more):
        return {**base, "items": items, "truncated": more, "next_cursor": cursor_of(items[-1]) if more and items else None}

    fits = lambda p: len(canonical(p)) <= budget
    items = rows[:limit]
    while items and not fits(build(items, len(items) < len(rows))):
        if len(items) == 1:
            if not clip or not items[0].get(clip):
                raise ValueError("one row does not fit into the response")
            lo, hi = 0, len(items[0][clip])
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if fits(build([{**items[0], clip: items[0][clip][:mid], "clipped": True}], len(rows) > 1)) else (lo, mid - 1)
            items = [{**items[0], clip: items[0][clip][:lo], "clipped": True}]
            break
        items = items[:-1]
    return build(items, len(items) < len(rows))

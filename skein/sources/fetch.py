"""Fetching pages from a chat API on the driver, to be landed for Spark's readers.

The API is a parameter: a function that gives one page. Nothing here touches
rows beyond a page.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any


class RateLimited(Exception):
    """The API asks to wait; ``retry_after`` says how long if it told."""

    def __init__(self, retry_after: float | None = None):
        super().__init__(f"rate limited, retry after {retry_after}")
        self.retry_after = retry_after


@dataclass
class Page:
    messages: list[dict[str, Any]]
    cursor: str | None = None


def with_backoff(call: Callable[[], Any], attempts: int = 5, base: float = 1.0, jitter: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """``call``, tried again when rate limited: after the time asked for, else a doubling one with some jitter."""
    for i in range(attempts):
        try:
            return call()
        except RateLimited as e:
            if i == attempts - 1:
                raise
            sleep(e.retry_after if e.retry_after is not None else base * 2**i + random.uniform(0, jitter))
    raise ValueError("attempts must be positive")


def fetch_roots(
    page: Callable[[str | None, int], Page], cursor: str | None = None, limit: int | None = None, page_size: int = 200, **backoff: Any
) -> tuple[list[dict[str, Any]], str | None, bool]:
    """(thread roots, next cursor, whether more is left). Whole pages are kept, so the last one can go past the limit."""
    out: list[dict[str, Any]] = []
    while True:
        got = with_backoff(lambda at=cursor: page(at, page_size), **backoff)
        out += [m for m in got.messages if m.get("thread_ts") in (None, m.get("ts"))]
        cursor = got.cursor
        if not cursor:
            return out, None, False
        if limit is not None and len(out) >= limit:
            return out, cursor, True


def fetch_after(page: Callable[[int, int], list[dict[str, Any]]], last: int = 0, limit: int | None = None, page_size: int = 200, **backoff: Any) -> list[dict[str, Any]]:
    """Messages with a number above ``last``, oldest first, a page at a time."""
    out: list[dict[str, Any]] = []
    while True:
        got = with_backoff(lambda at=last: page(at, page_size), **backoff)
        out += got
        if len(got) < page_size or (limit is not None and len(out) >= limit):
            return out if limit is None else out[:limit]
        last = max(int(m["message_id"]) for m in got)


def land(messages: Iterable[dict[str, Any]], folder: str | Path, channel: str) -> Path | None:
    """One JSON file of a fetch; its name is its content's hash, so a repeated fetch lands once."""
    lines = [json.dumps({"channel": channel} | m, sort_keys=True, default=str) for m in messages]
    if not lines:
        return None
    body = "\n".join(lines)
    path = Path(folder) / f"{channel.strip('@')}-{hashlib.sha1(body.encode()).hexdigest()[:16]}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body, encoding="utf-8")
    return path


def each_channel(channels: Iterable[str], fetch: Callable[[str], Any]) -> tuple[dict[str, Any], list[str]]:
    """(results by channel, errors): a channel that fails is reported and the others go on."""
    done, errors = {}, []
    for c in channels:
        try:
            done[c] = fetch(c)
        except Exception as e:  # noqa: BLE001
            errors.append(f"Channel {c}: {e}")
    return done, errors

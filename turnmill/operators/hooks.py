"""Calls of model hooks: a list of items at a time, failed items again, one error per item."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

#: Items of one call, unless the caller says otherwise.
BATCH_SIZE = 32


def slices(items: list, size: int) -> Iterator[list]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def ask_all(
    items: list,
    one: Callable,
    many: Callable | None = None,
    tries: int = 1,
    first_wait: float = 0.0,
    step: float = 0.0,
) -> list:
    """What a hook gives for each item: its result, or the exception it failed with.

    ``many`` takes a list and returns as many results, of which some may be exceptions. A hook
    without it, or whose call fails as a whole, is asked item by item with ``one``. Only failed
    items are tried again, after growing pauses.
    """
    found, waiting = [None] * len(items), list(range(len(items)))
    for attempt in range(tries):
        for i, result in zip(waiting, _attempt([items[i] for i in waiting], one, many)):
            found[i] = result
        waiting = [i for i in waiting if isinstance(found[i], Exception)]
        if not waiting:
            break
        if attempt < tries - 1:
            time.sleep(first_wait + step * attempt)
    return found


def _attempt(items: list, one: Callable, many: Callable | None) -> list:
    if many is not None:
        try:
            found = list(many(items))
            if len(found) == len(items):
                return found
        except Exception:
            pass  # one bad item must not fail the others: each is asked by itself below
    return [_caught(one, item) for item in items]


def _caught(one: Callable, item):
    try:
        return one(item)
    except Exception as exc:
        return exc

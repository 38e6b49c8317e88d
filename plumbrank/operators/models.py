"""Injected models in Python workers: loaded once for a process, fed with texts of like length."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle

#: Bytes of text in one call of a model, at most, or those of one text.
CALL_BYTES = 1 << 20

_models: dict[str, Any] = {}


def name_of(descriptor: dict[str, Any], load: Callable | None) -> str:
    """What tells a model from others: its descriptor, and the function that loads it."""
    return hashlib.md5(repr(sorted(descriptor.items())).encode() + cloudpickle.dumps(load)).hexdigest()


def loaded(key: str, load: Callable[[], Any]) -> Any:
    """The model that `load` gives, once for each worker process: a reused worker has it already."""
    if key not in _models:
        _models[key] = load()
    return _models[key]


def calls(sizes: list[int], count: int, most: int = CALL_BYTES) -> Iterator[list[int]]:
    """Places of texts in order of their sizes, in calls of at most `count` texts and `most` bytes: little padding, bounded memory."""
    held, total = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if held and (len(held) == count or total + sizes[i] > most):
            yield held
            held, total = [], 0
        held.append(i)
        total += sizes[i]
    if held:
        yield held


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))

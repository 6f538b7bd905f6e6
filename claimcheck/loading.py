"""Models that a Python worker loads once, however many tasks it runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle

_loaded: dict[str, Any] = {}


def model_key(load: Callable[[], Any]) -> str:
    """A name for a loader and all that it closes over: equal loaders have equal names."""
    return hashlib.sha256(cloudpickle.dumps(load)).hexdigest()


def load_once(key: str, load: Callable[[], Any]) -> Any:
    """What ``load`` returned in this process the first time it was asked for under ``key``."""
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]

"""Single flight and short memory for identical lookups."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from functools import wraps
from typing import Any


def coalesce(ttl: float, most: int = 64, clock: Callable[[], float] = time.monotonic):
    """Calls with equal arguments share one running call, and its result for ``ttl`` seconds.

    Errors reach every caller that waited and are not kept.
    """

    def decorate(function: Callable) -> Callable:
        lock = threading.Lock()
        kept: dict[Any, tuple[float, Any]] = {}
        running: dict[Any, tuple[threading.Event, list]] = {}

        @wraps(function)
        def call(*args, **named):
            key = (args, tuple(sorted(named.items())))
            with lock:
                if key in kept and clock() - kept[key][0] < ttl:
                    return kept[key][1]
                mine = key not in running
                done, box = running.setdefault(key, (threading.Event(), []))
            if not mine:
                done.wait()
                ok, value = box[0]
                if ok:
                    return value
                raise value
            try:
                box.append((True, function(*args, **named)))
            except BaseException as e:
                box.append((False, e))
                raise
            finally:
                with lock:
                    running.pop(key)
                    if box[0][0]:
                        now = clock()
                        kept[key] = (now, box[0][1])
                        if len(kept) > most:
                            for old in [k for k, (t, _) in kept.items() if now - t >= ttl]:
                                kept.pop(old)
                done.set()
            return box[0][1]

        return call

    return decorate

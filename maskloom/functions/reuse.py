"""Columns that are built once per session: a chain of detectors takes thousands of calls to the JVM."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column

#: Columns kept for a session; the one used longest ago goes first.
MOST = 64
_BUILT: WeakKeyDictionary[SparkContext, OrderedDict[tuple, Column]] = WeakKeyDictionary()


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """`build`, a function of hashable arguments that names its columns, with what it built kept for the session.

    Without a context in this process (Spark Connect) every call builds.
    """
    @wraps(build)
    def run(*args) -> Column:
        context = SparkContext._active_spark_context
        if context is None:
            return build(*args)
        built = _BUILT.setdefault(context, OrderedDict())
        key = (build.__module__, build.__qualname__, args)
        if key not in built:
            built[key] = build(*args)
            while len(built) > MOST:
                built.popitem(last=False)
        built.move_to_end(key)
        return built[key]

    return run

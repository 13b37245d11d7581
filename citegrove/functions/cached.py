"""Reuse of long column expressions within a session."""
from functools import wraps

from pyspark import SparkContext

_built: dict = {}


def per_session(build):
    """A column expression is immutable, so one built from the same (hashable) arguments is built once a session."""
    @wraps(build)
    def wrapper(*args):
        key = (id(SparkContext._active_spark_context), build.__module__, build.__qualname__, args)
        if key not in _built:
            _built[key] = build(*args)
        return _built[key]
    return wrapper

"""Sends modules with Python workers along with the functions that use them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(name: str) -> None:
    """Functions of this module are pickled by value, so executors needn't have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])

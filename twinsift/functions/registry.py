"""User extension points: named fingerprints and metrics.

A fingerprint is a function from a DataFrame and its key column to rows (key, fp); a
metric is a weight and a column expression.  Both are plain columns, so user functions
registered as Arrow UDFs fit as well as built-in expressions.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Metric:
    name: str
    weight: float
    value: Column | None = None
    digits: int = 3

    @property
    def direction(self):
        return (self.weight > 0) - (self.weight < 0)


_fingerprints: dict[str, Callable[[DataFrame, str], DataFrame]] = {}
_metrics: dict[str, Metric] = {}


def register_fingerprint(name, fn):
    _fingerprints[name] = fn
    return fn


def fingerprint(name):
    return _fingerprints[name]


def register_metric(metric: Metric):
    _metrics[metric.name] = metric
    return metric


def metrics():
    return dict(_metrics)

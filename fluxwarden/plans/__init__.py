"""Driver queries: each module registers its own."""

from . import alerting, analysis, datasets, detection, features, graphs, models, more, streams
from .registry import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL

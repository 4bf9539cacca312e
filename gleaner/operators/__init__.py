"""Distributed operators: joins, aggregations, samples, models, ranking."""

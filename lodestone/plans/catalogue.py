"""The query catalogue: name -> Spark callable and name -> DuckDB SQL."""

from __future__ import annotations

from lodestone.plans import answers, details, guards, history, lookups, meters, model, records, relations, sources_model, texts, views

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (history, relations, texts, model, lookups, views, guards, meters, sources_model, records, answers, details):
    for _name, (_run, _sql) in _module.CATALOGUE.items():
        QUERIES[_name] = _run
        if _sql is not None:
            ORACLES[_name] = _sql

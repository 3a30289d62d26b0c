"""Every registered query with, where SQL can say it, the SQL that checks it."""

from tidewell.catalogue import aggregates, charts, flows, history, joins, profiles, projection, sources, streams

_MODULES = (projection, joins, aggregates, sources, profiles, history, flows, charts, streams)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}

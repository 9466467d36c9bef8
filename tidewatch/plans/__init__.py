"""Named queries over the driver tables, each with its check in SQL where SQL can say it."""

from tidewatch.plans import evaluation, models, scans, sequences, splits, statistics, streams

_AREAS = (scans, splits, sequences, statistics, evaluation, streams, models)
QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: text for area in _AREAS for name, text in area.ORACLES.items()}
flagship = sequences.split_train_windows

"""DataFrame-in / DataFrame-out operators (column names are arguments)."""

from wattle.operators import (  # noqa: F401
    aggregate, clean, encode, folds, joins, model, project, score, setops, timeseries,
)

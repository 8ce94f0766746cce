"""wattle — Spark-native feature and forecasting operators for hourly metered time series.

Every public operator is a function ``DataFrame -> DataFrame`` (or a column
expression) whose column names are arguments, so the same code runs on the
building/weather/readings star and on any table mapped onto it.

Sub-packages
------------
sources    readers, row positions, sinks, driver-table adapters
functions  column expressions (targets, meteorology, calendar, arithmetic)
operators  cleaning, joins, aggregation, time series, set ops, encoding,
           folds, scoring, model training
plans      end-to-end compositions (training / scoring frames, pipelines)
streaming  micro-batch scoring wrapper around the batch plans
"""

__version__ = "0.1.0"

"""tradewatch: market-surveillance analytics composed from Spark DataFrame operators.

Layers
------
sources    raw envelopes, JSON parsing, dead-letter split, adapters from the driver tables
functions  Column -> Column helpers (time boundaries, masks, risk score, severity rank)
operators  generic DataFrame operators (either-key join, band join, as-of join, upsert,
           look-back de-duplication, snapshot diff, latest row, time-sliced rolling windows)
plans      the surveillance pipeline (harmonise, features, scores, rules, alerts, cases,
           governance, reports) as functions DataFrame -> DataFrame
streaming  Structured Streaming forms of the time-based parts
"""

__all__ = ["session", "params"]

"""Spark-native analytics over daily, region-keyed public-service volumes.

Everything is a plain function from DataFrame to DataFrame (or Column to
Column), so operators chain with ``df.transform`` and Catalyst sees one plan.

- ``wardwise.sources``    drop-folder CSV ingestion, canonical tables, exports
- ``wardwise.functions``  column functions (text, dates, seeded draws, messages)
- ``wardwise.operators``  aggregates, rankings, forecast, anomalies, governance
- ``wardwise.plans``      page-level compositions that share one fact scan
- ``wardwise.streaming``  incremental ingestion of a growing drop folder
"""

"""fleetlens: fleet and benchmark analytics on Spark.

Operators are plain functions from DataFrames to DataFrames:

* ``fleetlens.sources``   - config YAML, KEY=value files, JSON listings, logs and result tables
* ``fleetlens.functions`` - Column functions (fallback rules, sizes, names, addresses)
* ``fleetlens.operators`` - profiles, inventory, benchmark, proxy rules, sizing, graph, ordered positions
* ``fleetlens.sinks``     - rendered outputs (inventory lines, documents, scrape targets) and writers
* ``fleetlens.plans``     - composed pipelines (run report, validation, provisioning, cluster config)
* ``fleetlens.streaming`` - Structured Streaming forms with watermarks and per-key state
"""

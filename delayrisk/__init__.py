"""Shipment delay-risk analytics on Spark.

Feature building, delay labels, a distributed random-forest model, batch
scoring with enrichment, and the dashboard queries -- each stage is a
DataFrame plan that Catalyst optimizes and Spark runs across executors.

Sub-packages:

* ``sources``   -- table resolution, the test-fixture adapter, sinks
* ``functions`` -- Column -> Column helpers (draws, risk maps, text)
* ``operators`` -- DataFrame -> DataFrame building blocks
* ``plans``     -- end-to-end jobs (feature table, training, scoring, mart)
"""

ID = "masterbill_internal_id"

__all__ = ["ID"]

"""lodestar: embedding tuning and retrieval evaluation as Spark jobs.

Public entry points (all take and return Spark DataFrames):

* ``operators.tune``: ``QuerySet``, ``tune_n``, ``tune_m``
* ``operators.retrieval``: ``topk``, ``top1``, ``topk_scores``, ``candidate_narrowing``
* ``operators.metrics``: ``evaluate``, ``per_query``, ``hit_at_1``
* ``operators.datasets``, ``operators.embed``, ``operators.adapter``, ``sources.io``
* ``streaming.embed_stream``
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]

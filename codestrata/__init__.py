"""codestrata: Spark-native analytics over measurements of source code.

Facts about nested subjects (callable, class, namespace, project), dependency edges and policy tables go in; roll-ups,
graph measures, scores, findings, baselines and reports come out, each as a lazy DataFrame plan.
"""

__version__ = "0.1.0"

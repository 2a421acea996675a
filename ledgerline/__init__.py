"""ledgerline: a Spark-native lending warehouse.

Extract -> stage -> dimensions -> facts, analytical views, change capture,
data-quality rules, payment posting, snapshots and micro-batch loading, all
expressed with the DataFrame / SQL API so Catalyst plans the work.
"""

__version__ = "0.1.0"

"""tessera: a Spark-native workbench for labelled tabular classification.

Every operator is a DataFrame -> DataFrame function (or a pyspark.ml
Estimator) so Catalyst plans it and executors run it; fitted statistics
are small, size-checked tables that enter later plans as literals or
broadcast joins.
"""

__version__ = "0.1.0"

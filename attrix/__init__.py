"""attrix: binary-outcome customer analytics as Spark DataFrame operators.

Every public operator is a function ``f(df, ...) -> DataFrame`` (or a
``pyspark.ml`` Estimator/Transformer) whose work runs on Spark.  Rows are
matched by an explicit ``key`` column, never by position.
"""

__version__ = "0.1.0"

"""companion: companion-item recommendation analytics on Spark.

Operators take and return DataFrames and stay in native Spark expressions.
Layout:

* ``sources``    readers/writers (record files, CSV) and the fixture mapping
* ``functions``  column-expression helpers (seeded hashing, ranking metrics)
* ``operators``  DataFrame -> DataFrame building blocks
* ``plans``      end-to-end pipelines and the registered queries
"""

__all__ = ["operators", "sources", "functions", "plans"]

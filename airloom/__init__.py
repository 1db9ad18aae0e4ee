"""Content-operations analytics as lazy Spark DataFrames.

Sub-packages:

* ``sources``   - table schemas, batch and streaming readers
* ``functions`` - column expressions (time, tags)
* ``operators`` - batch operators, DataFrame in and DataFrame out
* ``streaming`` - the operators that run on an unbounded stream
* ``plans``     - stand-in entities over the driver tables and the registered queries
"""

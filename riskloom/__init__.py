"""Change-risk analytics over version-control history, as Spark DataFrame operators.

Sub-packages:

* ``sources``   - scans and sinks (logs, token files, matrices, reports)
* ``functions`` - column expressions shared by the operators
* ``operators`` - DataFrame -> DataFrame steps
* ``plans``     - compositions of the steps, and views over the star-schema tables
"""

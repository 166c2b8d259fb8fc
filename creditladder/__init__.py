"""Loan-portfolio credit-risk analytics as Spark DataFrame jobs.

Layers, from the bottom up:

* ``functions``: column expressions (null rules, parsing, the category ladder, features);
* ``operators``: DataFrame -> DataFrame steps (joins, windows, file order, aggregates, checks);
* ``sources``: readers for the raw exports and the result sinks;
* ``plans``: whole computations (loan-month panel, exposure and loss, model families, scoring).
"""

"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Conventions that hold for every operator here:

* An operator selects the columns it needs and renames them inside, so other columns of the
  input, whatever their names, neither clash nor matter.
* Null text counts as empty text, a null id is a value of its own, repeated rows are separate
  rows, and an empty table gives an empty result with the same columns.
* Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``.
"""

"""Operators for preparing large text, media, web and vector collections for model training.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames;
what has to be written in between goes to the shared folder in ``spark.checkpoint.dir``.
"""

"""inkwell: a DataFrame engine for text corpora and ranked result lists.

Every operator takes and returns DataFrames. Expressions stay in Catalyst
wherever they can state the semantics; steps that are sequential by nature run
as Arrow batches. Nothing reads the wall clock: operators that need "today"
take an explicit ``as_of``.
"""

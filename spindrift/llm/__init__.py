"""Training-data operators: one module per operator, nothing outside this folder imports them.

Every operator is a function of DataFrames; ``spindrift.llm.queries`` binds each to its table.
"""

"""Training-data operators: ten Spark jobs over documents, pages and benchmark items.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries.py`` wires them to the test tables.
"""

"""SQL that recomputes the registered queries from the raw tables in one analytical engine.

Written as plain window functions over the whole stream: slow and unpartitioned, but independent of
the way the Spark plans cut the work.
"""

"""Table discovery over data lakes, expressed as Spark DataFrame jobs.

The common currency is the long-form ``cells`` DataFrame
``(table_id, row_idx, col_idx, col_name, value)``: one physical schema for any
number of heterogeneous tables.  ``row_idx`` is always the dense 0-based
position of the row inside its table; operators that drop or reorder rows
renumber it.
"""

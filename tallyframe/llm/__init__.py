"""Operators for large-scale training-data pipelines.

One subpackage, imported by nothing else in the library.  Each module holds one
operator with its own general interface; :mod:`.queries` binds them to the
registered ``opN_<name>`` queries and :mod:`.sql` holds their SQL.
"""

"""Training-data operators. Nothing else in the library imports this subpackage.

Each module holds one operator with its general interface and the thin
``opN_<name>`` query over the driver tables; ``registry`` collects the queries.
"""

"""paperloom: document collections as Spark DataFrames.

The package turns mixed documents into relational tables (sources, units,
annotations, chunks, entries, vectors) and answers searches over them.
Everything is a plan over DataFrames; Python runs only where no built-in
expression can state the rule.
"""

__version__ = "0.1.0"

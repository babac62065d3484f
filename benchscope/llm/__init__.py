"""Training-data operators: ten corpus operators and the pipeline built from them.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""

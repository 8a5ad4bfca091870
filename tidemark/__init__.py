"""tidemark: incremental document indexing and corpus processing on PySpark.

Everything is expressed as DataFrame plans; Python runs only where the work itself is Python's
(text extraction, model calls, array kernels over Arrow batches). The optional subpackage ``llm``
builds on this package; nothing here imports it.
"""

__version__ = "0.1.0"

"""quillframe: PySpark operators for serialized-text catalogues and the jobs that produce them."""

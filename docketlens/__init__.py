"""docketlens: document-evidence analytics as PySpark DataFrame jobs."""

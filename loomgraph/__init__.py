"""Graph, evidence and corpus analytics expressed as PySpark DataFrame plans."""

"""marlstone: text retrieval and vector analytics expressed as Spark plans."""

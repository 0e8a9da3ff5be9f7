"""recallframe: an agent-memory and hybrid-retrieval analytics engine on PySpark."""

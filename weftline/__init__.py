"""weftline: document retrieval and question answering as Spark DataFrame plans."""

"""veldspar: document analytics and relational queries, declared as Spark plans."""

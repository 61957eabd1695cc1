"""Entity pipelines: compositions of operators, and the registered queries."""

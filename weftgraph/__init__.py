"""weftgraph: hypergraph, knowledge-graph and temporal-event analytics as Spark DataFrame plans."""

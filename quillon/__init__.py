"""quillon: document indexing, ranked search and corpus preparation on Apache Spark."""

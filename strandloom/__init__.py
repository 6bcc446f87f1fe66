"""strandloom: DNA homology, fragmentation and sequence-table processing on PySpark."""

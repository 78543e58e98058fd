"""Panel and risk analytics on claims-style tables, as DataFrame-in, DataFrame-out functions for Spark."""

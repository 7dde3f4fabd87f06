"""Evidence-backed temporal knowledge graphs and experience analytics on Spark."""

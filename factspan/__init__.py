"""Evidence-grade text and fact-history analytics on Spark."""

"""tidemark: corpus analytics for semi-structured postings on Spark."""

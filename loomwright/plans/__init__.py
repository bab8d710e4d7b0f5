"""From declared features to fused Spark plans, scores, the journal and the main sample."""

"""Post analytics on Spark: extract, de-duplicate, score, label and store posts."""

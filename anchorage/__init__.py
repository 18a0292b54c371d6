"""A link-corpus engine on Spark: extraction, statistics, rewriting, labelling, annotation."""

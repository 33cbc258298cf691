"""A document-curation engine on Spark."""

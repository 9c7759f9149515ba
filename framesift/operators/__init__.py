"""DataFrame-to-DataFrame operators of the curation steps."""

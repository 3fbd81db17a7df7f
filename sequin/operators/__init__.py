"""DataFrame -> DataFrame operators of the mining pipeline."""

"""Sources: trees of files, logs, manifests and reports as DataFrames."""

"""Knowledge graphs as DataFrames: storage, retrieval, provenance and spectra on Spark."""

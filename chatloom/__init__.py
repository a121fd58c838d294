"""chatloom: curation and annotation of developer-assistant chat corpora on Spark DataFrames."""

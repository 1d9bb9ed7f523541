"""palimpsest: reports, retrieval and text analytics expressed as Spark DataFrame plans."""

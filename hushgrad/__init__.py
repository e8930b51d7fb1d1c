"""hushgrad: private-gradient pipelines and model evaluation as Spark DataFrame plans."""

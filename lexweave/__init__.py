"""Evidence-based document review over whole corpora, as Spark DataFrame operators."""

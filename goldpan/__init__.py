"""goldpan: star-schema warehouse exploration as Spark DataFrame operators."""

"""vexel: similarity search and the analytics around it, as Spark DataFrame plans."""

"""A Spark-first engine that finds credentials in bulk text and reports them without their values."""

"""Column builders: expressions over one row, evaluated in the JVM without a shuffle."""

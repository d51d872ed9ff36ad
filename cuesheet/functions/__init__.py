"""Column -> Column building blocks; none of them shuffles or leaves the JVM."""

"""Column helpers shared by the operators. All run inside the JVM."""

"""Column expressions.  All of them run in the JVM unless their docstring says otherwise."""

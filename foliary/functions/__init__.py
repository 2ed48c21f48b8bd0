"""Scalar functions as Column builders: everything runs inside the JVM."""

"""Column builders: vectors, distance fields, polynomial and spherical features. All are JVM expressions."""

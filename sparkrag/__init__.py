"""Spark jobs for building, searching and measuring multi-tenant document collections."""

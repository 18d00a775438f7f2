"""Plumbline: prose analytics expressed as Spark DataFrame plans."""

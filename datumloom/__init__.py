"""Relational dataset assurance, protection and synthesis as Spark DataFrame operators."""

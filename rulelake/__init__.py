"""Spark-native governed analytics: fact tables, rulesets, provenance graphs, document pipelines and ledgers."""

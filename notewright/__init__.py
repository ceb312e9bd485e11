"""Spark-native analytics over dialogues, propositions, problem states and notes."""

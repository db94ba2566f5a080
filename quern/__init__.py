"""Spark-native curation, grading and evaluation of question-answer data."""

"""A Spark-native engine that turns questionnaires into tables and analyses them."""

"""Spark-native analytics over keyed, ordered event tapes."""

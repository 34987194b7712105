"""Windowed analytics over keyed, ordered sensor signals, expressed as Spark DataFrame operators."""

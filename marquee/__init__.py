"""Marquee: programme analytics and large-scale data preparation on Spark."""

"""Price-bar analytics as DataFrame operators on Spark."""

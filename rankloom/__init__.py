"""rankloom: search and ranking analytics as DataFrame -> DataFrame operators on Spark."""

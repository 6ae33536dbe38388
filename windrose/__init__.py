"""windrose: rating, ranking and corpus analytics as plain DataFrame functions on Spark."""

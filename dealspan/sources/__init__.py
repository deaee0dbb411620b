"""Reading, cleaning, writing and profiling tables."""

"""Session-based behavioural and neural time-series analytics as Spark DataFrame operators."""

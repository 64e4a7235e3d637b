"""Panel-indicator analytics jobs on Spark; training-data jobs are in the optional subpackage llm."""

"""skein: code-graph analytics and data processing on PySpark."""

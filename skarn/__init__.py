"""skarn: a relational SQL dialect and data-processing engine on PySpark."""

"""skein: grounded-retrieval analytics and corpus operators on PySpark."""

"""Array kernels in numpy: no Spark in here."""

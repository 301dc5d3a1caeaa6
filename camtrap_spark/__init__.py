"""PySpark jobs for curating camera-trap image collections and for training-data pipelines."""

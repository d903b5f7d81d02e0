"""trajspark: road-network and GPS-trajectory analytics on PySpark."""

"""padlake: padded, differentially private join analytics on PySpark."""

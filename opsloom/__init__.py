"""opsloom: operations analytics expressed as Spark DataFrame plans."""

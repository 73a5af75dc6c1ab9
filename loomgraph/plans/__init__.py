"""Plan building blocks shared by the operators: durable cuts in the lineage and skew-proof joins."""

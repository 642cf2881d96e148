"""Analysis of records about the same people kept by several systems, one extract per term."""

"""Training-data operators: search, mixing, tokenisation, archives, de-duplication, labelling, sharding."""

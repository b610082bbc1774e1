"""Training-data operators: sharding, packing, filters, tokenization, privacy and near-duplicate search."""

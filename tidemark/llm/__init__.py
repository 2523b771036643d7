"""Training-data operators: packing, mixing, scoring, scanning and near-duplicate search on DataFrames."""

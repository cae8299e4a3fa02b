"""DataFrame operators: spatial joins, stacks, planning, ordered folds, OSM assembly, tile inspection."""

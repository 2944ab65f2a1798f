"""DataFrame operators: match, breakdown, quality, duplicate files, sets, linearize."""

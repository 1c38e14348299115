MODULES = ("views", "groups", "grids", "climates", "tag_rules", "shapes_ops", "requests", "feeds")

from pixelloom.operators import frames, images, recipes, records  # noqa: F401

"""Row-local column expressions: calendar, physics, categories, climate normals, text."""

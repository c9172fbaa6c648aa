"""Column expressions: plate texts, boxes, polygons."""

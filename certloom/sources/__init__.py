"""Reading sheets, texts, catalogues and tasks; writing tables."""

"""Operators on texts for language-model training data: packing, mixing and one form of look-alike texts."""

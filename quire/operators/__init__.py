"""Relational operators over chapters, paragraphs, scenes, cards and logs."""

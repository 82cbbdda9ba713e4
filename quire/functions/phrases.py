"""Phrase tables that tell what a question asks.  Fixed values, in plain English as users type them."""

from __future__ import annotations

# fixed values: questions about the ending
ENDING = (
    "how does the story end", "how does it end", "how does this end", "story end", "story ends", "book end", "book ends", "manuscript end",
    "manuscript ends", "novel end", "novel ends", "at the end of the story", "by the end of the story", "at the end of the book",
    "by the end of the book", "at the end of the novel", "by the end of the novel", "at the end of the manuscript", "by the end of the manuscript",
    "the ending", "ending", "conclusion", "concludes", "resolution", "resolved", "epilogue", "final scene", "final chapter", "last scene",
    "last chapter", "last paragraph", "last page", "is it complete", "does it feel complete", "feels complete", "complete ending",
)
# fixed values: questions for a summary
SUMMARY = (
    "summary", "summarize", "synopsis", "recap", "overview", "what is the story about", "what is the book about", "what is the novel about",
)
# fixed values: questions for a list of characters
INVENTORY = (
    "main characters", "principal characters", "major characters", "all characters", "list characters", "list the characters",
    "who are the characters", "characters in the story", "cast of characters", "character list",
)
# fixed values: questions about how characters change in general
GENERIC_ARC = (
    "character arc", "character arcs", "character development", "character develops", "characters develop", "characters change",
    "main characters change", "principal characters change", "protagonist arc", "protagonist change", "protagonist changes",
)
# fixed values: words of change
CHANGE = (
    "change", "changes", "changed", "changing", "develop", "develops", "developed", "development", "evolve", "evolves", "evolved", "grow", "grows", "grew",
)
# fixed values: openings that make change a question about someone
HOW_DOES = ("how does", "how do", "does", "do")
# fixed values: words of theme and style
THEME = ("theme", "themes", "motif", "motifs", "symbol", "symbolism", "style", "voice", "tone", "structure")
# fixed values: words for the whole
BROAD = (
    "overall", "whole story", "story as a whole", "whole book", "whole novel", "broad", "across the story", "throughout the story", "entire story",
    "entire book", "entire novel",
)
# fixed values: words of character questions
CHARACTER = (
    "character", "characters", "protagonist", "antagonist", "narrator", "pov", "point of view", "who is", "who are", "relationship", "relationships",
    "know", "knows", "believe", "believes", "want", "wants", "motivation", "motivations", "arc", "arcs",
)
# fixed values: words that ask for a chapter, and modes that ask for characters or themes
CHAPTER = ("chapter", "chapter by chapter")
CHARACTER_MODES = ("continuity", "development")
THEME_MODES = ("interpretation", "style")

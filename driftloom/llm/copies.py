"""Responses that only copy their prompt, by compression with the prompt as dictionary."""

from __future__ import annotations

import re

from driftloom.llm.languages import script_of

WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_ECHO_LEAD = re.compile(r"^(?:you (?:asked|ask)|question|your question|prompt|the question (?:is|was)|role instruction)\s*:?\s*", re.I)


def copies(prompt: str, core: str) -> bool:
    """The response offers nothing beyond its prompt: beside it, its normalised text nearly vanishes, and hardly a word of it is new.

    Words in another order compress less well, so a response half as well compressed must have even fewer new words."""
    import zstandard

    said = WORDS.findall(_ECHO_LEAD.sub("", core.lower()))
    asked = WORDS.findall(prompt.lower())
    plain, source = " ".join(said), " ".join(asked)
    if len(plain) < 12:
        return False
    alone = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(plain.encode()))
    beside = len(zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(source.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(plain.encode())) if len(source) >= 8 else alone
    if beside > 0.75 * alone and not (len(plain) >= 200 and beside <= 40):  # a long text that repeats itself is small either way
        return False
    spaced = not script_of(plain)
    known = set(asked) if spaced else None
    new = sum(w not in known for w in said) / len(said) if spaced else sum(c not in source for c in plain) / len(plain)
    return new <= 0.15 if beside > 0.45 * alone else new <= 0.34

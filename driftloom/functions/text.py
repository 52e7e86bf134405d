"""Text, identifier and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space: every character that a Unicode-aware split takes as such.
WS = r"(?U)[\s\x1c-\x1f]"


# Fixed value: what begins an item of a list.
LIST_ITEM = WS.replace("(?U)", r"(?U)\n", 1) + r"*(?:[-*]|\d+[.)])" + WS.replace("(?U)", "") + "+"


def collapse(t: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(t, WS + "+", " "))


def strip(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, f"^{WS}+", ""), f"{WS}+$", "")


def word_count(t: Column) -> Column:
    c = collapse(t)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def clipped(t: Column, n: int) -> Column:
    c = collapse(t)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def previews(t: Column, n: int) -> dict[str, Column]:
    """Start, middle and end of a text, each collapsed."""
    middle = F.greatest(F.lit(0), F.floor(F.length(t) / 2).cast("int") - n // 2)
    return {"preview_start": clipped(F.left(t, F.lit(n)), n), "preview_middle": clipped(F.substring(t, middle + 1, F.lit(n)), n), "preview_end": clipped(F.right(t, F.lit(n)), n)}


def step_of(revision: Column) -> Column:
    """N of 'stepN', null for anything else."""
    return F.regexp_extract(revision, "^step([0-9]+)$", 1).try_cast("bigint")


def window_parts(t: Column) -> tuple[Column, Column]:
    """Both revisions of a window written with ->, :, - or _to_; null where it is none."""
    pattern = "^(step[0-9]+)(?:->|:|-|_to_)(step[0-9]+)$"
    bare = F.replace(t, F.lit(" "), F.lit(""))
    return tuple(F.nullif(F.regexp_extract(bare, pattern, k), F.lit("")) for k in (1, 2))


def sanitized(t: Column) -> Column:
    return F.regexp_replace(t, "[^a-zA-Z0-9_.-]+", "_")


def cleaned_response(t: Column, strip_lists: bool = True, trim_to_sentence: bool = True) -> Column:
    """Stripped; without lists, up to the first list item, where a colon at the end, with what blanks it, becomes a full stop; trimmed, up to
    the last end of a sentence, if there is any."""
    head = strip(t)
    if strip_lists:
        head = strip(F.element_at(F.split(head, LIST_ITEM, 2), 1))
        head = F.regexp_replace(head, WS + r"*:\z", ".")
    if trim_to_sentence:
        sentence = F.regexp_extract(head, r"(?s)^(.*[.?!]).*$", 1)
        head = F.when(sentence != "", sentence).otherwise(head)
    return head


def selection_hash(seed: int, namespace: str, ident: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(namespace), ident.cast("string")), 256)


def list_hash(values: Column) -> Column:
    """SHA-256 of the compact JSON list."""
    return F.sha2(F.to_json(values), 256)

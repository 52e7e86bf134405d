"""Texts cut off by field limits: length hazards, and endings that are not the end of a text.

Lengths. For each source and measure (characters as stored, characters without marks and blanks at the end, words) the discrete hazard at a
length is the number of texts that end there over those at least as long. Window functions pool the hazards of the neighbouring lengths; the
Chernoff bound of the Poisson tail, widened by how far the neighbours vary around their pooled hazard, gives each length's p-value, and
Benjamini-Hochberg per source and measure controls the false discoveries. A second round leaves the lengths found by the first out of the
neighbours, so that a limit does not hide the lengths beside it (values cut at a limit and then trimmed). Significant lengths are field limits.

Endings. ``describe`` reads the end of a text: an open code block, quotation or bracket, a joining mark or an abbreviation at the end is
incomplete; terminal punctuation, a closed table row, tag, quotation or bracket is complete. What ends in a bare word is judged by the
corpus: how often its last word, as a beginning of a word, goes on after the same word before it, against how often texts end just there.
Texts that end at a significant length are no witnesses that a text may end there, and for a text at one (or with debris, or with a stored
word count above its own) the bar for a complete ending is higher.

Routes. A cut text at a significant length is of route ``limit``. Values that broke off mid-transfer have no length in common, so no test of
lengths can find them: they are those whose ending alone is incomplete, route ``transfer``.

Defined cases: null, blank and filler texts have no content and are not cut; marks left at the cut do not complete a text; one-word
answers are complete; rows of one key count once (the least row by its features); an empty table gives empty results; an unknown source is
a source of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.copies import copies
from driftloom.session import spread

# Fillers that stand for no answer, compared in lower case without blanks and invisible characters.
FILLERS = frozenset(("<empty>", "<|endoftext|>", "[no response]", "(no response)", "<no response>", "no response", "n/a", "null", "nil", "nan", "(blank)", "[blank]", "<blank>", "(empty)", "[empty]", "(none)", "tbd", "todo", "answer:", "response:", "output:", "assistant:", "antwort:", "respuesta:", "réponse:", "resposta:"))
# Abbreviations after which a text goes on.
ABBREVIATIONS = frozenset(("e.g.", "i.e.", "vs.", "no.", "cf.", "approx.", "incl.", "esp.", "fig.", "dr.", "mr.", "mrs.", "ms.", "prof.", "st.", "z.b.", "d.h.", "bzw.", "ca.", "nr.", "u.a.", "p.ej.", "ej.", "sr.", "sra.", "núm.", "p.ex.", "ex.", "env.", "par."))
# Answers that an abbreviation's letters also spell; complete when they are the whole text.
WHOLE_ANSWERS = frozenset(("no.",))

_INVISIBLE = "​‌‍⁠﻿­"
_BLANK = re.compile(rf"[\s{_INVISIBLE}]+")
_TAIL = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + _INVISIBLE
#: Marks and debris at a cut: ellipses, bracketed notes, replacement characters, halves of escapes and entities.
_DEBRIS = re.compile(r"(?:\[?(?:…|\.{3,})\]?|[\[(<](?:cut|truncated|abridged|snip|\.\.\.|…|continued|more)[\])>]|�+|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?|[nrt\"])?|&(?:#?\w{0,7};?)|<\|?(?:endoftext|eot|eos)?\|?>?)$", re.I)
_FENCE = re.compile(r"^\s*(```|~~~)", re.M)
_TERMINAL = ".!?。！？؟।॥｡"
_CLOSERS = "\"'”’»)]}」』*_`"
_LIST = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+\S")
_TAG = re.compile(r"</?\w")
_BRACKET = re.compile(r"(?<![:;])(?<![:;]-)[(\[]|[)\]]")
_WORD_END = re.compile(r"[.,;:!?\"'”’»)\]}]+$")
_DIGITS = re.compile(r"\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
MEASURES = ("chars", "core_chars", "words")
_FLUSH = 300_000


def is_blank(text: str | None) -> bool:
    """Null, blank, only marks, or a filler."""
    if text is None:
        return True
    bare = _BLANK.sub(" ", text).strip().lower()
    return bare in FILLERS or not any(c.isalnum() for c in bare)


def _closes_tag(text: str, end: int) -> bool:
    """A tag ends at ``end``."""
    at = text.rfind("<", 0, end - 1)
    return at >= 0 and text[end - 1] == ">" and text.find(">", at, end - 1) < 0 and _TAG.match(text, at) is not None


def core_of(text: str) -> tuple[str, bool]:
    """The text without blanks and debris at its end, and whether there was debris. Debris that is all of the text stays."""

    def bare(end: int) -> int:
        while end and text[end - 1] in _TAIL:
            end -= 1
        return end

    end, marked = bare(len(text)), False
    while True:
        low = max(0, end - 40)
        m = _DEBRIS.search(text[low:end])
        if not m or not low and not m.start():
            break
        if m.group() in ("<", ">", "&") or (m.group().endswith(">") and _closes_tag(text, end)):
            break
        end, run = end - len(m.group()), m.group()[0]
        while run in ".…\ufffd" and end and text[end - 1] == run:  # a run longer than what was looked at
            end -= 1
        end, marked = bare(end), True
    return text[:end], marked


def _open_quote(text: str) -> bool:
    for a, b in ("“”", "«»", "「」", "『』"):
        if text.rfind(a) > text.rfind(b):
            return True
    straight = [m.start() for m in re.finditer(r'(?<![\d\\])"', text)]
    return len(straight) % 2 == 1 and (straight[-1] == 0 or text[straight[-1] - 1] in " \n([") and straight[-1] + 1 <= len(text)


def _open_bracket(text: str) -> bool:
    """A bracket that nothing closes, of either kind; those of smileys aside, and closing ones that nothing opened."""
    depth = 0
    for m in _BRACKET.finditer(text):
        depth = depth + 1 if m.group() in "([" else max(0, depth - 1)
    return depth > 0


def _word(token: str) -> str:
    return _DIGITS.sub("0", _WORD_END.sub("", token).lower())


def contexts(text: str) -> Iterator[tuple[str, str, int, int, int]]:
    """(word before, word, ends the text bare, ends a sentence or line, ends a list item that others follow) for each word of a text."""
    lines = text.split("\n")
    for n, line in enumerate(lines):
        tokens, before = line.split(), "^"
        for i, token in enumerate(tokens):
            word = _word(token)
            if not word:
                continue
            last = i == len(tokens) - 1
            marked = _WORD_END.search(token) is not None
            inner = last and n < len(lines) - 1
            yield before, word, int(last and not inner and not marked), int(marked or inner), int(inner and not marked and _LIST.match(line) is not None)
            before = word


def describe(text: str) -> tuple[str, str, str, str, int, int, bool]:
    """(core, kind, word before, last word, characters of the core, words, debris) of a text that is not blank.

    kind: open (incomplete), closed (complete), single (one word), bare (a bare word ends it) or item (a bare word ends a list item)."""
    core, marked = core_of(text)
    words = core.split()
    last_line = core.rsplit("\n", 1)[-1]
    tokens = last_line.split()
    last = _word(tokens[-1]) if tokens else ""
    before = (_word(tokens[-2]) or "^") if len(tokens) > 1 else "^"
    fences = len(_FENCE.findall(core))
    end = core[-1:]
    plain = core if "```" not in core else re.sub(r"(?s)```.*?```", " ", core)
    if fences % 2:
        kind = "open"
    elif end == "`" and fences:
        kind = "closed"
    elif last_line.lstrip().startswith("|"):
        rows = [x for x in core.split("\n") if x.lstrip().startswith("|")]
        whole = end == "|" and rows[-1].count("|") >= max(r.count("|") for r in rows) and not re.fullmatch(r"[\s|:-]+", rows[-1])
        kind = "closed" if whole else "open"
    elif _open_quote(plain) or _open_bracket(plain):
        kind = "open"
    elif end in _TERMINAL:
        short = words[-1].lower().lstrip("(\"'")
        kind = "open" if short in ABBREVIATIONS and not (len(words) == 1 and short in WHOLE_ANSWERS) else "closed"
    elif end in "'’" and core[-2:-1] not in _TERMINAL + ",":  # an apostrophe rather than a quotation's end
        kind = "closed" if re.search(r"(?:^|[\s(])['‘]\S[^'‘’]*$", core[:-1]) else "open"
    elif end in _CLOSERS and len(core) > 1:
        kind = "closed"
    elif _closes_tag(core, len(core)) or ord(end) >= 0x2190 and not end.isalnum():
        kind = "closed"
    elif not end.isalnum() and end not in "%°€$£+":
        kind = "open"
    elif len(words) == 1 and not _CJK.search(core):
        kind = "single"
    elif _CJK.search(end):
        kind = "open" if len(core) > 12 or any(c in core for c in _TERMINAL) else "single"
    else:
        kind = "item" if _LIST.match(last_line) else "bare"
    return core, kind, before, last, len(core), len(words), marked


def _echoes(core: str, prompt: str | None) -> bool:
    """The text ends as its prompt does, or is nothing but its prompt: a copy is complete though its last mark may be gone."""
    if prompt and copies(prompt, core):
        return True
    words = re.findall(r"\w+", core.lower())[-6:]
    asked = re.findall(r"\w+", (prompt or "").lower())
    return len(words) >= 4 and (asked[-len(words) :] == words or sorted(asked[-len(words) :]) == sorted(words))


def features(df: DataFrame, key: str, text: str, prompt: str | None, word_count: str | None, source: Sequence[Column]) -> DataFrame:
    """One row per key: (key, source_1.., stated, blank, kind, before, last, echo, debris, chars, core_chars, words, bare_ends)."""
    names = [f"source_{i}" for i in range(1, len(source) + 1)]
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"),
        *(F.coalesce(s.cast("string"), F.lit("(null)")).alias(n) for s, n in zip(source, names)),
        (F.col(word_count) if word_count else F.lit(None)).cast("long").alias("stated"),
        F.col(text).alias("text"),
        (F.col(prompt) if prompt else F.lit(None)).cast("string").alias("prompt"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for t, p in zip(pdf["text"], pdf["prompt"]):
                if is_blank(t):
                    out.append((True, "blank", "", "", False, False, len(t or ""), 0, 0))
                    continue
                core, kind, before, last, chars, words, marked = describe(t)
                out.append((False, kind, before, last, kind in ("bare", "single") and _echoes(core, p), marked, len(t), chars, words))
            done = pdf.drop(columns=["text", "prompt"]).reset_index(drop=True)
            made = pd.DataFrame(out, columns=["blank", "kind", "before", "last", "echo", "debris", *MEASURES])
            yield pd.concat([done, made], axis=1)

    schema = "key string, " + "".join(f"{n} string, " for n in names) + "stated double, blank boolean, kind string, before string, last string, echo boolean, debris boolean, chars int, core_chars int, words int"
    found = spread(rows.withColumn("stated", F.col("stated").cast("double")), "key").mapInPandas(run, schema)
    rest = [c for c in found.columns if c != "key"]
    return found.groupBy("key").agg(F.min(F.struct(*rest)).alias("x")).select("key", "x.*")


def context_counts(df: DataFrame, text: str) -> DataFrame:
    """(before, last, n, ends, stops, items) over every word of every text that is not blank; repeated texts of the table count each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], list[int]] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(b, w, *c) for (b, w), c in held.items()], columns=["before", "last", "n", "ends", "stops", "items"])

        for pdf in frames:
            for t in pdf[text]:
                if is_blank(t):
                    continue
                for before, word, ends, stops, items in contexts(core_of(t)[0]):
                    c = held.setdefault((before, word), [0, 0, 0, 0])
                    c[0] += 1
                    c[1] += ends
                    c[2] += stops
                    c[3] += items
            if len(held) > _FLUSH:
                yield out()
                held.clear()
        if held:
            yield out()

    counts = spread(df.select(F.col(text).alias(text)), text).mapInPandas(run, "before string, last string, n long, ends long, stops long, items long")
    return counts.groupBy("before", "last").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("stops").alias("stops"), F.sum("items").alias("items"))


def going_on(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """For each candidate (before, last): goes_on, stops, items and n_own. Words that begin with ``last`` go on, and ``last`` itself where no text ends.

    Of the counted words only those after a candidate's word before are looked at, and of their beginnings only those as long as a candidate there."""
    wanted = candidates.select("before", "last").distinct()
    sizes = wanted.groupBy("before").agg(F.collect_set(F.length("last")).alias("sizes"))  # lengths of words
    near = counts.join(sizes, "before")
    beginnings = near.withColumn("begin", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.length("last")), lambda n: F.substring(F.col("last"), F.lit(1), n))))
    met = beginnings.withColumnRenamed("last", "whole").withColumnRenamed("begin", "last").join(wanted, ["before", "last"])
    own = F.col("whole") == F.col("last")
    return met.groupBy("before", "last").agg(
        F.sum(F.when(own, F.col("n") - F.col("ends")).otherwise(F.col("n"))).alias("goes_on"),
        F.sum(F.when(own, F.col("stops")).otherwise(0)).alias("stops"),
        F.sum(F.when(own, F.col("items")).otherwise(0)).alias("items"),
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n_own"),
    )


def significant_lengths(feats: DataFrame, source: Sequence[str], alpha: float = 0.01, width: int = 12, least: int = 5) -> DataFrame:
    """(source.., measure, length, n, at_risk, expected, p): lengths at which texts end far more often than at the lengths around."""
    long = feats.where("NOT blank").select(*source, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES))).alias("x"))
    hist = long.groupBy(*source, "x.measure", "x.length").agg(F.count(F.lit(1)).alias("n"))
    at_risk = F.sum("n").over(Window.partitionBy(*source, "measure").orderBy("length").rowsBetween(0, Window.unboundedFollowing))
    hist = hist.withColumn("at_risk", at_risk).withColumn("limit", F.lit(False))
    first = _tested(hist, source, alpha, width, least)
    second = _tested(first, source, alpha, width, least)
    return second.where("limit").select(*source, "measure", "length", "n", "at_risk", "expected", "p")


def _tested(hist: DataFrame, source: Sequence[str], alpha: float, width: int, least: int) -> DataFrame:
    """The lengths with expected, p and ``limit`` anew; lengths that were limits before are left out of their neighbours' hazards."""
    by = Window.partitionBy(*source, "measure").orderBy("length")
    near, beyond = by.rangeBetween(-width, width), by.rangeBetween(width + 1, Window.unboundedFollowing)
    first = F.greatest(F.col("length") - width, F.lit(1))
    last = F.least(F.col("length") + width, F.max("length").over(Window.partitionBy(*source, "measure")))
    free, own = ~F.col("limit"), (~F.col("limit")).cast("int")
    # Over all lengths from first to last, whether texts end there or not, a text of length m is at risk at min(m, last) - first + 1 of them.
    risks = F.sum(F.col("n") * F.col("length")).over(near) - (first - 1) * F.sum("n").over(near) + (last - first + 1) * F.coalesce(F.sum("n").over(beyond), F.lit(0))
    out = F.coalesce(F.sum(F.when(F.col("limit"), F.col("at_risk"))).over(near), F.lit(0))
    around = hist.withColumn("_lengths", last - first - F.sum(F.col("limit").cast("int")).over(near) + 1 - own).withColumn("_risks", risks - out - own * F.col("at_risk"))
    squares = F.col("n") * F.col("n") / F.col("at_risk")
    around = around.withColumn("_near", F.coalesce(F.sum(F.when(free, F.col("n"))).over(near), F.lit(0)) - own * F.col("n"))
    around = around.withColumn("_squares", F.coalesce(F.sum(F.when(free, squares)).over(near), F.lit(0.0)) - own * squares)
    hazard = F.when(F.col("_risks") > 0, F.col("_near") / F.col("_risks")).otherwise(0.0)
    around = around.withColumn("_hazard", hazard)
    tested = around.withColumn("expected", F.least(F.greatest(F.col("at_risk") * F.col("_hazard"), F.lit(0.5)), F.col("at_risk").cast("double")))
    n, mu = F.col("n"), F.col("expected")
    varied = (F.col("_squares") / F.col("_hazard") - F.col("_near")) / F.greatest(F.col("_lengths"), F.lit(1))  # neighbours that vary more than Poisson counts of one hazard
    spread = F.when(F.col("_hazard") > 0, F.greatest(F.lit(1.0), varied)).otherwise(1.0)
    tested = tested.withColumn("p", F.when(n <= mu, 1.0).otherwise(F.exp((n - mu + n * F.ln(mu / n)) / spread)))
    all_ = Window.partitionBy(*source, "measure")
    ranked = tested.withColumn("_rank", F.row_number().over(all_.orderBy("p", "length"))).withColumn("_tests", F.count(F.lit(1)).over(all_))
    ranked = ranked.withColumn("_last", F.coalesce(F.max(F.when(F.col("p") <= alpha * F.col("_rank") / F.col("_tests"), F.col("_rank"))).over(all_), F.lit(0)))
    return ranked.withColumn("limit", (F.col("_rank") <= F.col("_last")) & (n >= least)).select(*source, "measure", "length", "n", "at_risk", "expected", "p", "limit")


def truncated(df: DataFrame, feats: DataFrame, text: str, source: Sequence[str], limits: DataFrame | None = None) -> DataFrame:
    """The features of each key with ``at_limit``, ``cut`` and ``route`` (limit or transfer, null for whole texts).

    ``limits``: the significant lengths, made of the features unless given."""
    limits = significant_lengths(feats, source) if limits is None else limits
    limits = limits.groupBy(*source).agg(F.collect_set(F.concat_ws(":", "measure", "length")).alias("_limits"))
    own = F.array(*(F.concat_ws(":", F.lit(m), F.col(m)) for m in MEASURES))
    held = feats.join(limits, list(source), "left").withColumn("at_limit", F.coalesce(F.arrays_overlap("_limits", own), F.lit(False))).drop("_limits")
    bare = held.where(F.col("kind").isin("bare", "item"))
    judged = going_on(bare, context_counts(df, text))
    witnesses = bare.groupBy("before", "last").agg(F.count_if(~F.col("at_limit")).alias("ends"))
    rows = held.join(judged, ["before", "last"], "left").join(witnesses, ["before", "last"], "left")
    doubt = F.col("at_limit") | F.col("debris") | F.coalesce(F.col("stated") > F.col("words") + 2, F.lit(False))
    ends, on = F.coalesce("ends", F.lit(0)), F.coalesce("goes_on", F.lit(0))
    share = ends / F.greatest(ends + on, F.lit(1))
    known = F.when(F.col("words") <= 5, share >= 0.5).when(doubt, (share >= 0.9) & (ends >= 3)).otherwise((share >= 0.5) & (ends >= 2))
    stops = (F.coalesce("stops", F.lit(0)) >= 2) & (F.col("stops") >= 0.005 * F.col("n_own"))
    items = F.coalesce("items", F.lit(0)) >= 2
    complete = F.when(F.col("kind") == "item", known | (stops | items) & ~F.col("debris") & ~F.col("at_limit")).otherwise(known)
    broken = F.col("kind").isin("bare", "item") & ~complete & ~F.col("echo")
    single = (F.col("kind") == "single") & F.col("debris") & ~F.col("echo")
    rows = rows.withColumn("cut", ~F.col("blank") & ((F.col("kind") == "open") | broken | single)).drop("goes_on", "ends", "stops", "items", "n_own")
    return rows.withColumn("route", F.when(F.col("cut"), F.when(F.col("at_limit"), "limit").otherwise("transfer")))


def cut_shares(rows: DataFrame, source: Sequence[str]) -> DataFrame:
    """Per source: texts with content, cut texts, their share, and how many of the cut came by each route."""
    routes = [F.count_if(F.coalesce(F.col("route") == r, F.lit(False))).alias(f"cut_by_{r}") for r in ("limit", "transfer")]
    some = rows.where("NOT blank").groupBy(*source).agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_texts"), *routes)
    return some.withColumn("cut_share", F.col("cut_texts") / F.col("texts"))

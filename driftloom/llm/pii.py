"""Personal information in free text by information-theoretic sanitisation.

The first pass counts over the whole corpus how terms co-occur. Terms are words, pairs of neighbouring capitalised words ("A B", "A, B"), and shapes:
what a mail address, number or street address looks like, without its letters and digits ("+" telephones, "AA0" numbers, "[at]" mail). From these counts
a term's disclosure is the probability that one of its occurrences stands with a protected entity, and its information the logarithm of that over the
corpus rate. Terms above both thresholds make the lexicon, and nothing is found that the lexicon does not disclose:

* shapes: how often words that label an entity of their kind stand around them. A shape's share is drawn towards that of all shapes of its kind by
  PRIOR occurrences, so that rare shapes are judged by their kind. Shapes that nothing else has reveal their entity by themselves once they disclose;
  shapes that harmless counts share, and shapes below the threshold, need a disclosing word around them;
* words around telling shapes (form, badge, call) vouch for such entities;
* surnames follow given names, given names precede surnames; from the table of given names both lexicons grow in rounds of joins on the
  counted pairs. Words that are mostly something else (Will, Grace) stay below the threshold and are marked as ambiguous.

The second pass looks for the shapes and for names, and generalises each that is disclosed to the placeholder of its type.

Scale: both passes are map-only over the texts; what is shuffled are counts of distinct terms and pairs after partial aggregation. Executors get
the terms above the threshold as a hashed table of 2 CELLS bytes, a size that does not grow with the data; a term counts only if both its
cells are set, and ``confirmed`` removes names that rest on a collision by a join with the lexicon itself.

Defined cases: null and empty texts hold nothing; texts are read whole; a type and text counts once per document; overlaps go to the type first in
mail, number, telephone, address, name; a name broken over a line end is found as its parts; the part of a mail address before the sign has at most 64
characters, as the standard says, and what is longer is none; without given names or pairs no names are found; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.session import cut, spread

CELLS = 1 << 22
GIVEN, SURNAME, AMBIGUOUS, NEAR_ID, NEAR_PHONE, NEAR_MAIL, NEAR_ADDRESS, TELLING, SEEN = (1 << i for i in range(9))
TYPES = ("email", "id_number", "phone", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Least probability that an occurrence of a term stands with an entity, and least information in bits over the corpus rate.
DISCLOSURE, BITS, ROUNDS = 0.15, 4.0, 3
#: From this probability on, a given name that is mostly another word counts before a surname, and a shape may be vouched for.
WEAK = 0.02
#: Occurrences of a kind that a shape's own are added to.
PRIOR = 5
_FLUSH = 400_000

# --- words and names -----------------------------------------------------------------------------------------------
_CAP = r"(?:[OD]['’])?[A-ZÀ-ÖØ-Þ]\w+(?:[-’'][A-ZÀ-ÖØ-Þ]\w+)*"
# Particles of surnames.
_PARTICLE = r"(?:(?:de la|de las|de los|van der|van den|van de|von der|von dem|de|da|do|dos|di|du|del|della|der|den|van|von|zu|al|el|bin|ibn|ter|le|la|af|av) )"
#: What follows the first letter of such a word.
_CAP_REST = r"(?:(?<=[OD])['’][A-ZÀ-ÖØ-Þ])?\w+(?:[-’'][A-ZÀ-ÖØ-Þ]\w+)*"
#: A capitalised word after an initial, or two capitalised words with a blank or comma between them: (first or all, word after initial, comma, second).
#: It begins with a capital, which the search leaps to.
_PAIR = re.compile(rf"([A-ZÀ-ÖØ-Þ](?<![\w@./+-].)(?:(?<=[A-Z])\. {_PARTICLE}?({_CAP})(?!\.? ?\d)|{_CAP_REST}(?=(,?) (?:[A-Z]\. )?{_PARTICLE}?({_CAP})(?!\.? ?\d|\. [a-z\d]))))")
#: Stands for the given name behind an initial.
_ANY_GIVEN = "~"
# Titles and greetings, which no name begins with.
TITLES = frozenset(
    "mr mrs ms miss dr prof sir madam frau herr herrn fräulein mme mlle monsieur madame sr sra srta señor señora señorita senhor senhora dona don doña signor signora dhr mevrouw "
    "hi hello hey dear hallo hola olá bonjour ciao liebe lieber sehr thanks thank best kind regards wishes from to cc bcc by re fwd and or the contact kontakt mail call text ask both met "
    "alte alter altes neue neuer am an auf im zum zur calle avda avenida plaza paseo camino ronda rua via rue street road flat box apt".split()
)
_GREETING = frozenset("hi hello hey dear hallo hola olá bonjour ciao liebe lieber thanks cc".split())
_TOKEN_EDGE = re.compile(r"^[^\w]+|(?:['’]s)?[^\w]+$|['’]s$")
_PREFIX = re.compile(r"^[OoDd]['’](?=\w{3})")
_SPLIT = re.compile(r"[^\w'’]+|_")
_DIGIT = re.compile(r"\d")
_ONES = str.maketrans("23456789", "1" * 8)

# --- numbers -------------------------------------------------------------------------------------------------------
# Shapes of numbers of documents and registers that nothing else has.
_ID = re.compile(
    r"(?<![\w.+/=-])(?:[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{2}\d{7}|[A-Z]{2} \d{3} \d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{8}[A-HJ-NP-TV-Z]|[XYZ]\d{7}[A-HJ-NP-TV-Z]|\d{3}\.\d{3}\.\d{3}-\d\d|\d\d \d{3} \d{3} \d{3}|\d{6}-\d{5})(?![\w-]|[.:/]\d| \d)"
)
# The shape of social security numbers, which other counts share.
_ID_SHARED = re.compile(r"(?<![\w.+/-])\d{3}([- ])\d\d\1\d{4}(?![\w-]|[.:/]\d)")
# Telephone numbers with an international prefix, an area in brackets, or four groups; a label and a colon may stand right before them.
_PHONE = re.compile(
    r"(?:(?<![\w.+/:-])|(?<=[Tt]el:)|(?<=TEL:)|(?<=[Pp]hone:)|(?<=[Ff]ax:)|(?<=sms:)|(?<=[Mm]obile:)|(?<=callto:))(?:\+\d{1,3}(?:[ ./-]?\(0?\d{0,4}\))?(?:[ ./-]?\d{1,12}){1,6}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\(0\d{1,4}\) ?\d{2,5}(?:[ -]\d{2,5}){0,3}|1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4})(?![\w-]|[.:/]\d)"
)
# A trunk prefix, or ten digits in three groups, which other counts share.
_PHONE_SHARED = re.compile(r"(?<![\w.+/:-])(?:0[1-9](?: \d\d){4}|0[1-9]\d{0,4}[ /]\d{3,8}(?:[ -]\d{2,6}){0,3}|\d{3}([-. ])\d{3}\1\d{4})(?![\w-]|[.:/]\d)")
# Words that label entities of each kind.
NEAR = {
    NEAR_ID: "ssn passport licence license tax taxid insurance national identity dni nie cpf nif ni steuer steuerid ausweis reisepass pasaporte passeport social badge tax_ref",
    NEAR_PHONE: "phone tel telephone mobile cell call called calling sms fax whatsapp telefon handy teléfono móvil téléphone telefone dial text",
    NEAR_MAIL: "mail mails email mailto contact write cc bcc to from reply reach reached resend bounced forward correo courriel schreiben escribir écrire kontakt",
    NEAR_ADDRESS: "address lives lived live home street flat ship shipped parcel post deliver delivery adresse anschrift wohnt dirección domicilio domicile endereço indirizzo lautet",
}
_LABELS = {bit: frozenset(words.split()) for bit, words in NEAR.items()}
KINDS = {"email": NEAR_MAIL, "id_number": NEAR_ID, "phone": NEAR_PHONE, "address": NEAR_ADDRESS}

# --- mail ----------------------------------------------------------------------------------------------------------
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?$")
_LOCAL_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789._%+-"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
# Generic and reserved top-level domains; others have two letters.
_TLD = r"(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|museum|coop|aero|jobs|mobi|travel|email|online|site|app|dev|example|test|invalid|localhost|[a-z]{2})"
_DOT = r"(?:\.| ?[\[(]dot[\])] ?| dot )"
_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*?{_DOT}{_TLD}(?![a-z0-9-]|{_DOT}{_LABEL})")
#: What stands for the sign between name and domain.
_AT = tuple(re.compile(p) for p in (r"@", r"＠", r" ?\[at\] ?", r" ?\(at\) ?", r" at (?=[a-z0-9-]+(?:\.| dot | ?[\[(]dot))"))
_AT_MARKS = ("@", "＠", "[at]", "(at)", " at ")
_COUNTED = re.compile(r"^(?:step|layer|epoch|head|block|checkpoint|v)\d+\.")

# --- street addresses ----------------------------------------------------------------------------------------------
# Words that end a street's name in English.
_STREETS = "Street St Road Rd Avenue Ave Lane Ln Boulevard Blvd Close Row Terrace Gardens Way Drive Dr Court Ct Place Pl Square Sq Crescent Mews Walk Parkway Quay Grove".split()
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) ?#?\d{1,4}[A-Za-z]?"
_TOWN = r"[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+){0,2}"
_CODE = r"(?:(?:[A-Z]{2} )?\d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})"
_TAIL = rf"(?:,? ?\n? ?{_TOWN},? {_CODE}(?!\d)|, {_TOWN}(?!\w))"
_ENGLISH = re.compile(rf"(?:(?<!\w){_UNIT}, )?(?<![\w.,/:=-])\d{{1,5}}[A-Za-z]? (?:[A-Z][\w'’-]+ ){{1,4}}?(?:{'|'.join(_STREETS)})\b\.?(?:,? {_UNIT})?(?:{_TAIL})?")
_BOX = re.compile(rf"P\.? ?O\.? ?Box \d{{1,6}}(?:{_TAIL})?")
_PLACE = r"[A-ZÀ-Þ][\w'’-]+(?: (?:am|an der|im|in der|bei|ob der|de la|de los|de|del|du|des|sur|la|le|los) [A-ZÀ-Þ][\w'’-]+| [A-ZÀ-Þ][\w'’-]+){0,2}"
_SEP = r"(?:, ?|,? ?\n ?)"
_GERMAN = re.compile(rf"(?<![\w-])(?:(?:Am|An|Auf|Im|Zum|Zur|Alte|Alter|Altes|Neue|Neuer|Neues|Hohe|Obere|Untere|Kleine|Große)(?: (?:der|dem|den))? )?[A-ZÄÖÜ][\wäöüß-]*\.? \d{{1,4}} ?[a-z]?{_SEP}\d{{5}} {_PLACE}")
_FRENCH = re.compile(rf"(?<!\w)\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|allée|chemin|quai|place|impasse|route|cours|square|passage|sentier)(?: [\w'’-]+){{1,6}}?{_SEP}\d{{5}} {_PLACE}")
_SPANISH = re.compile(rf"(?<!\w)(?:Calle|C/|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Travesía|Rua|Via|Viale|Piazza) ?(?:(?:de|del|la|las|los|el|da|do|dei|della) )*[A-ZÀ-Þ][\w'’-]+(?: (?:(?:de|del|la) )*[A-ZÀ-Þ][\w'’-]+)* \d{{1,4}}(?:, \d{{1,2}}\.?º(?: (?:[A-Z](?!\w)|[a-z]{{2,5}}\.))?)?{_SEP}\d{{5}} {_PLACE}")
_STREET_WORDS = frozenset(_STREETS)
_ROMANCE = frozenset("rue avenue boulevard allée chemin quai place impasse route cours square passage sentier Calle Avda Av Avenida Plaza Pza Paseo Camino Ronda Travesía Rua Via Viale Piazza C".split())
_CALL_NAME, _CALL_NUMBER, _CALL_STREET, _CALL_BOX, _CALL_POSTCODE, _CALL_ROMANCE = (1 << i for i in range(6))
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_FIVE = re.compile(r"\d{5}")
_POSTCODE = re.compile(r"(?:\W*|.*,)\d{5}(?!\d)")


def terms_of(token: str) -> list[str]:
    """The terms of a raw token: lower case, without marks around it, O' or D', a possessive ending; parts of a double name are terms each."""
    bare = _TOKEN_EDGE.sub("", token)
    if "@" in token or "＠" in token:
        return []
    return [p for part in _SPLIT.split(bare) if (p := _PREFIX.sub("", part).lower()) and p.isalpha()]


#: Tokens that may belong to a number of a person: a sign or trunk prefix, groups with separators, letters before digits.
_NUMBER_TOKEN = re.compile(
    r"(?<![\w.])(?!\d{4}-\d\d-\d\dT)(?:[+(]\d|0\d{2,4}(?![\w.=:-])|\d{1,8}[-/.]\d{2,8}[-/.)]\d|\d{3}[-/]\d{4,}|\d{6}-\d{5}|0\d{2}/\d{4,}|\d{8}[A-Z]|[A-Z]{1,2}\d{3,}[\w-]*|[A-Z]{2}\d\d(?!\w)|[A-Z]{2}(?![\w=:]))"
)
#: Groups of digits with blanks between them; a trunk prefix and a longer group; four groups with mixed separators. Every shape of a number has one of these or a token above.
#: Each begins with a character that the search leaps to.
_SPACED = (re.compile(r" (?<=\d\d.)\d{2,5}(?![\w.])"), re.compile(r"0[1-9]\d{0,4}[ /]\d{3}"), re.compile(r"1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}"))


def _number_lines(text: str, tokens: Iterable[str]) -> list[tuple[int, int]]:
    return _lines(text, tokens, 0, sorted(m.start() for p in _SPACED for m in p.finditer(text)))


def _lines(text: str, tokens: Iterable[str], more: int = 0, places: Iterable[int] = (), second: Iterable[str] = ()) -> list[tuple[int, int]]:
    """Bounds of the lines (and ``more`` lines after each) that hold one of the tokens or places, in order and joined where they touch.

    Tokens that are among ``second`` take the line before theirs as well."""
    bounds = set()
    done = -1
    for at in places:
        if at > done:
            done = text.find("\n", at)
            done = done if done >= 0 else len(text)
            bounds.add((text.rfind("\n", 0, at) + 1, done))
    for token in tokens:
        at = text.find(token)
        while at >= 0:
            lo = text.rfind("\n", 0, at) + 1
            if lo and token in second:
                lo = text.rfind("\n", 0, lo - 1) + 1
            end = hi = text.find("\n", at)
            for _ in range(more):
                hi = text.find("\n", hi + 1) if hi >= 0 else hi
            bounds.add((lo, hi if hi >= 0 else len(text)))
            at = text.find(token, end) if end >= 0 else -1  # one find a line
    joined: list[tuple[int, int]] = []
    for lo, hi in sorted(bounds):
        if joined and lo <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(hi, joined[-1][1]))
        else:
            joined.append((lo, hi))
    return joined


# --- what may be an entity -----------------------------------------------------------------------------------------
def _words_beside(text: str, at: int, n: int, ahead: bool) -> list[str]:
    """The n tokens of the line next to ``at``, however long they are."""
    size = 80
    while True:
        near = text[at : at + size] if ahead else text[max(0, at - size) : at]
        line = near.split("\n", 1)[0] if ahead else near.rsplit("\n", 1)[-1]
        tokens = line.split()
        if len(line) < len(near) or len(near) < size or len(tokens) > n:
            return tokens[:n] if ahead else tokens[-n:]
        size *= 4


def _around(text: str, start: int, end: int, n: int = 5) -> list[str]:
    return [t for w in _words_beside(text, start, n, False) + _words_beside(text, end, n, True) for t in terms_of(w)]


def _back(text: str, at: int, chars: str) -> int:
    """Where the run of ``chars`` that ends at ``at`` begins."""
    while at and text[at - 1] in chars:
        at -= 1
    return at


class _Taken:
    """Spans of one text that do not overlap."""

    def __init__(self, size: int) -> None:
        self.marks = bytearray(size)

    def add(self, start: int, end: int) -> bool:
        """Takes the span unless it overlaps one that is taken."""
        if self.marks.find(1, start, end) >= 0:
            return False
        self.marks[start:end] = b"\x01" * (end - start)
        return True


def _shape_of(kind: str, found: str) -> str:
    """The term of an entity's shape: no word of a text can be equal to it."""
    if kind == "email":
        return "email:" + next((m.strip() for m in _AT_MARKS if m in found.lower()), "@")
    if kind == "phone" and found[0] in "+(":
        return "phone:" + found[0]
    return f"{kind}:" + _RUN.sub("0", _LETTER.sub("A", found))


_RUN, _LETTER = re.compile(r"\d+"), re.compile(r"[A-Za-z]")


def _strong(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of numbers of shapes that nothing else has."""
    taken = _Taken(len(text))
    for m in _ID.finditer(text):
        taken.add(*m.span())
        yield "id_number", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m.group()) <= 15 and taken.add(*m.span()):
            yield "phone", m.start(), m.end()


def _candidates(text: str, called: dict[str, int]) -> Iterator[tuple[str, str, bool, int, int]]:
    """(kind, shape, whether nothing else has it, start, end) of what looks like mail, a number or an address."""
    for a, b in _mails(text):
        yield "email", _shape_of("email", text[a:b]), True, a, b
    for lo, hi in _number_lines(text, [t for t, w in called.items() if w & _CALL_NUMBER]):
        line = text[lo:hi]
        for kind, a, b in _strong(line):
            yield kind, _shape_of(kind, line[a:b]), True, lo + a, lo + b
        for kind, shape in (("id_number", _ID_SHARED), ("phone", _PHONE_SHARED)):
            for m in shape.finditer(line):
                yield kind, _shape_of(kind, m.group()), False, lo + m.start(), lo + m.end()
    seen = 0
    for wanted in called.values():
        seen |= wanted
    if seen & (_CALL_STREET | _CALL_BOX | _CALL_POSTCODE):
        codes = {t for t, w in called.items() if w & _CALL_POSTCODE}  # the street may stand on the line before, and call for nothing
        for lo, hi in _lines(text, [t for t, w in called.items() if w & (_CALL_STREET | _CALL_BOX | _CALL_POSTCODE | _CALL_ROMANCE)], 1, second=codes):
            for style, a, b in _addresses(text[lo:hi], seen):
                yield "address", f"address:{style}", True, lo + a, lo + b


# --- first pass ----------------------------------------------------------------------------------------------------
def count_terms(df: DataFrame, text: str) -> DataFrame:
    """(kind, a, b, n, low): kind w words, p pairs "a b", v pairs "b, a" (a given name second in the text), s shapes a of kind b with those beside a label
    in ``low``, c words a around shapes b that nothing else has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, pairs, near, shapes, labelled = Counter(), Counter(), Counter(), Counter(), Counter()
        calls = _Roles(np.zeros(1, np.uint16))

        def out() -> pd.DataFrame:
            rows, low = Counter(), Counter()
            for token, n in words.items():
                if not token.isalpha() and _DIGIT.search(token):
                    continue  # numbers and settings; what stands with a name is counted by its pair at least
                for t in (token.lower(),) if token.isalpha() else terms_of(token):
                    rows["w", t, ""] += n
                    if token[:1].islower():
                        low["w", t, ""] += n
            for (a, alone, comma, b), n in pairs.items():
                for x in [_ANY_GIVEN] if alone else terms_of(a):
                    for y in terms_of(alone or b):
                        rows["v" if comma else "p", y if comma else x, x if comma else y] += n
            for (t, shape), n in near.items():
                rows["c", t, shape] += n
            for (kind, shape), n in shapes.items():
                rows["s", shape, kind] += n
                low["s", shape, kind] += labelled[kind, shape]
            return pd.DataFrame([(*k, n, low[k]) for k, n in rows.items()], columns=["kind", "a", "b", "n", "low"])

        for pdf in frames:
            for t in pdf[text]:
                if not t:
                    continue
                tokens = t.split()
                words.update(tokens)
                pairs.update(_PAIR.findall(t))
                for kind, shape, own, start, end in _candidates(t, calls.calling(set(tokens))):
                    beside = set(_around(t, start, end))
                    shapes[kind, shape] += 1
                    labelled[kind, shape] += not beside.isdisjoint(_LABELS[KINDS[kind]])
                    if own:
                        near.update((w, shape) for w in beside)
            if len(words) + len(pairs) + len(near) > _FLUSH:
                yield out()
                words, pairs, near, shapes, labelled = Counter(), Counter(), Counter(), Counter(), Counter()
        if words:
            yield out()

    counts = spread(df.select(F.col(text).alias(text)), text).mapInPandas(run, "kind string, a string, b string, n long, low long")
    return counts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("low").alias("low"))


def disclosing_terms(spark: SparkSession, counts: DataFrame, given: DataFrame, given_column: str) -> DataFrame:
    """The lexicon: (term, roles, disclosure, bits) of terms above the thresholds; roles are added bits.

    ``counts`` is used several times and should be materialised."""
    words = counts.where("kind = 'w'").select(F.col("a").alias("term"), "n", "low")
    pairs = counts.where("kind IN ('p', 'v')").groupBy(F.col("a").alias("first"), F.col("b").alias("last")).agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    known = given.select(F.explode(F.split(F.lower(F.col(given_column)), r"[-\s]+")).alias("term")).where("term <> ''").unionByName(spark.createDataFrame([(_ANY_GIVEN,)], "term string")).distinct()
    givens = known
    titles = spark.createDataFrame([(t,) for t in sorted(TITLES)], "term string")

    def scored(hits: DataFrame) -> DataFrame:
        """(term, disclosure, bits) over the words' own counts; the corpus rate is one number."""
        rate = (hits.agg(F.sum("hits")).first()[0] or 0) / max(total, 1)
        rows = hits.join(words, "term", "left")
        rows = rows.withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), "hits")).withColumn("low", F.coalesce("low", F.lit(0)))
        rows = rows.withColumn("disclosure", F.col("hits") / F.col("n"))
        return rows.withColumn("bits", F.log2(F.col("disclosure") / F.lit(max(rate, 1e-300))))

    def telling(rows: DataFrame) -> DataFrame:
        return rows.where((F.col("disclosure") >= DISCLOSURE) & (F.col("bits") >= BITS) & (F.col("low") <= 0.8 * F.col("n")))

    for _ in range(ROUNDS):
        after = pairs.join(givens.withColumnRenamed("term", "first"), "first", "left_semi").groupBy(F.col("last").alias("term")).agg(F.sum("n").alias("hits"))
        s = telling(scored(after)).join(titles, "term", "left_anti").join(known, "term", "left_anti")
        surnames = cut(s.select("term", "disclosure", "bits"))
        before = pairs.join(surnames.withColumnRenamed("term", "last"), "last", "left_semi").groupBy(F.col("first").alias("term")).agg(F.sum("n").alias("hits"))
        g = telling(scored(before)).join(titles, "term", "left_anti").join(surnames, "term", "left_anti")
        givens = cut(g.select("term").unionByName(known).distinct())
    people = scored(before).select("term", "disclosure", "bits", "n", "low")
    rare = people.where((F.col("disclosure") >= WEAK) & (F.col("bits") >= BITS)).select("term").join(titles, "term", "left_anti").join(surnames, "term", "left_anti")
    own = givens.unionByName(rare).distinct().join(people, "term", "left").join(words.select("term", F.col("n").alias("seen"), F.col("low").alias("seen_low")), "term", "left")
    seen, share = F.coalesce("seen", F.lit(0)), F.coalesce("disclosure", F.lit(0.0))
    vague = (share < DISCLOSURE) & (seen >= 5) | (F.coalesce("seen_low", F.lit(0)) > 0.3 * seen)
    lexicon = own.select("term", F.when(vague, GIVEN | AMBIGUOUS).otherwise(GIVEN).alias("roles"), share.alias("disclosure"), F.coalesce("bits", F.lit(0.0)).alias("bits"))
    lexicon = lexicon.unionByName(surnames.select("term", F.lit(SURNAME).alias("roles"), "disclosure", "bits"))
    shapes = counts.where("kind = 's'").groupBy(F.col("a").alias("shape"), F.col("b").alias("of")).agg(F.sum("n").alias("n"), F.sum("low").alias("hits"))
    kinds = shapes.groupBy("of").agg((F.sum("hits") / F.sum("n")).alias("share"), F.sum("hits").alias("all_hits"))  # one row per kind
    shapes = shapes.join(F.broadcast(kinds), "of").withColumn("disclosure", (F.col("hits") + PRIOR * F.col("share")) / (F.col("n") + PRIOR))
    shapes = shapes.withColumn("bits", F.log2(F.col("disclosure") * max(total, 1) / F.greatest(F.col("all_hits"), F.lit(1))))
    telling_shapes = (F.col("disclosure") >= DISCLOSURE) & (F.col("bits") >= BITS)
    shapes = cut(shapes.where(F.col("disclosure") >= WEAK).withColumn("roles", F.when(telling_shapes, SEEN | TELLING).otherwise(SEEN)))
    lexicon = lexicon.unionByName(shapes.select(F.col("shape").alias("term"), "roles", "disclosure", "bits"))
    own = shapes.where(F.col("roles") > SEEN).select(F.col("shape").alias("b"), "of")
    around = counts.where("kind = 'c'").join(own, "b").groupBy("of", F.col("a").alias("term")).agg(F.sum("n").alias("hits"))
    for kind, role in KINDS.items():
        near = scored(around.where(F.col("of") == kind).drop("of"))
        terms = near.where((F.col("hits") >= 3) & (F.col("disclosure") >= DISCLOSURE) & (F.col("bits") >= BITS)).select("term", "disclosure", "bits")
        labels = spark.createDataFrame([(t, kind) for t in sorted(_LABELS[role])], "term string, of string").join(own.select("of").distinct(), "of", "left_semi")
        terms = terms.unionByName(labels.select("term", F.lit(0.0).alias("disclosure"), F.lit(0.0).alias("bits")))  # labels count where their kind is disclosed
        lexicon = lexicon.unionByName(terms.select("term", F.lit(role).alias("roles"), "disclosure", "bits"))
    return lexicon.groupBy("term").agg(F.bit_or("roles").alias("roles"), F.max("disclosure").alias("disclosure"), F.max("bits").alias("bits"))


def _cells(term: str, size: int) -> tuple[int, int]:
    b = term.encode()
    return zlib.crc32(b) % size, zlib.crc32(b, 0x9E3779B9) % size


def to_table(lexicon: DataFrame, size: int = CELLS) -> np.ndarray:
    """The roles of the lexicon's terms in a table of ``size`` cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(c, r) for t, r in zip(pdf["term"], pdf["roles"]) for c in _cells(t, size)]
            yield pd.DataFrame(rows, columns=["cell", "roles"])

    set_ = lexicon.select("term", F.col("roles").cast("int")).mapInPandas(run, "cell int, roles int").groupBy("cell").agg(F.bit_or("roles").alias("roles")).toPandas()  # at most ``size`` rows
    table = np.zeros(size, np.uint16)
    table[set_["cell"].to_numpy(np.int64)] = set_["roles"].to_numpy(np.uint16)
    return table


# --- second pass ---------------------------------------------------------------------------------------------------
class _Roles(dict):
    """Roles of words; kept for as many as fit."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.idle: set[str] = set()  # raw tokens that call for nothing
        self.calls: dict[str, int] = {}  # raw tokens and what they call for
        self.shapes: dict[str, int] = {}  # the same for tokens with digits, all of which but 0 are alike there

    def term(self, t: str) -> int:
        a, b = _cells(t, len(self.table))
        return int(self.table[a] & self.table[b])

    def __missing__(self, word: str) -> int:
        own, roles = [self.term(t) for t in terms_of(word)], 0
        if own:
            roles = own[-1]  # a double name is what its last part is, if all its parts are known
            for r in own[:-1]:
                roles &= r | ~(GIVEN | SURNAME)
        if len(self) > 300_000:
            self.clear()
        self[word] = roles
        return roles

    def call(self, token: str) -> int:
        """What a raw token calls for: a look for names, numbers or addresses on its line."""
        wanted = 0
        for w in (token,) if token.isalpha() else _LETTERS.findall(token):
            if self[w] & (GIVEN | SURNAME):
                wanted |= _CALL_NAME
            if w in _STREET_WORDS:
                wanted |= _CALL_STREET
            if w == "Box":
                wanted |= _CALL_BOX
            if w in _ROMANCE:
                wanted |= _CALL_ROMANCE
        if "C/" in token:
            wanted |= _CALL_ROMANCE
        if _NUMBER_TOKEN.search(token):
            wanted |= _CALL_NUMBER
        if _FIVE.search(token) and _POSTCODE.match(token):
            wanted |= _CALL_POSTCODE
        return wanted

    def calling(self, tokens: set[str]) -> dict[str, int]:
        fresh = tokens - self.idle
        found = {}
        for token in fresh:
            wanted = self.calls.get(token)
            if wanted is None:
                shape = token.translate(_ONES)
                wanted = self.shapes.get(shape)
                if wanted is None:
                    wanted = self.call(token)
                    if _DIGIT.search(token):
                        self.shapes[shape] = wanted
                    elif wanted:
                        self.calls[token] = wanted
                    else:
                        self.idle.add(token)
            if wanted:
                found[token] = wanted
        if len(self.idle) + len(self.calls) + len(self.shapes) > 500_000:
            self.idle, self.calls, self.shapes = set(), {}, {}
        return found


def _mails(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    ats = sorted((m.span() for mark, p in zip(_AT_MARKS, _AT) if mark in low for m in p.finditer(low)))
    end_of_last = 0
    for start, end in ats:
        if start < end_of_last:
            continue
        at = max(end_of_last, _back(low, start, _LOCAL_CHARS))
        local = _LOCAL.search(low, at, start)
        if not local or start - local.start() > 64:
            continue
        domain = _DOMAIN.match(low, end)
        if not domain or _COUNTED.match(domain.group()):
            continue
        if low[start:end] == " at " and "dot" not in domain.group() and not re.search(r"[\d._+-]", local.group()):
            continue  # "look at example.com"
        end_of_last = domain.end()
        yield local.start(), domain.end()


def _disclosed(text: str, kind: str, shape: str, own: bool, start: int, end: int, roles: _Roles) -> bool:
    """The shape discloses and nothing else has it; or the shape is known to stand with entities, and something around vouches for this one."""
    role = roles.term(shape)
    if own and role & TELLING:
        return True
    return bool(role & SEEN) and _vouched(text, start, end, KINDS[kind], roles)


def _vouched(text: str, start: int, end: int, bit: int, roles: _Roles) -> bool:
    """Some word around discloses entities of this kind, a mail address or name stands by, or the entity fills its field or line."""
    around = [roles.term(t) for t in _around(text, start, end)]
    if any(r & bit for r in around):
        return True
    left = _back(text, start, " \t-*•")
    if (not left or text[left - 1] == "\n") and _LINE_ENDS.match(text, end):
        return True
    left = _back(text, start, " \t\r\f\v")
    if (left < start and text[left] == "\t" or left and text[left - 1] in ";>|(") and _FIELD_ENDS.match(text, end):
        return True
    return any(r & (GIVEN | SURNAME) and not r & AMBIGUOUS for r in around)


_LINE_ENDS, _FIELD_ENDS = re.compile(r"[ \t.,;]*(?:\n|$)"), re.compile(r"[^\S\n]*[;<|\t)]")


def _addresses(text: str, seen: int) -> Iterator[tuple[str, int, int]]:
    if seen & _CALL_STREET:
        for m in _ENGLISH.finditer(text):
            yield "english", *m.span()
    if seen & _CALL_BOX:
        for m in _BOX.finditer(text):
            yield "box", *m.span()
    if seen & _CALL_POSTCODE:
        if seen & _CALL_ROMANCE:
            for style, shape in (("french", _FRENCH), ("spanish", _SPANISH)):
                for m in shape.finditer(text):
                    yield style, *m.span()
        for m in _GERMAN.finditer(text):
            yield "german", *m.span()


_WORDS = re.compile(r"(?:[OoDd]['’])?[^\W\d_]+(?:[-’'][^\W\d_]{2,})*")
_INITIALS = re.compile(r"(?<![\w.])((?:[A-Z]\. ?)+)(?:%s)?$" % _PARTICLE)
_GAP = re.compile(r" (?:([A-Z])\. )?(?:%s)?$" % _PARTICLE)


def _shape(word: str) -> str:
    return "upper" if word.isupper() and len(word) > 1 else "title" if word[:1].isupper() else "lower"


def _names_of_line(line: str, roles: _Roles) -> Iterator[tuple[int, int, list[str]]]:
    words = []
    for m in _WORDS.finditer(line):
        w = m.group()
        end = m.end()
        if w[-1] in "sS" and w[-2:-1] in ("'", "’"):
            w, end = w[:-2], end - 2
        role = roles[w]
        if role:
            before, after = line[m.start() - 1 : m.start()], line[end : end + 1]
            apart = before in ("_", "+", "-", "/", "\\") or before == "." and not line[m.start() - 2 : m.start() - 1].isupper() or after in ("_", "@", "+", "/") or before.isdigit() or after.isdigit()
            role = 0 if apart else role
        words.append((m.start(), end, w, role))
    used = 0
    n = len(words)
    i = 0
    while i < n:
        start, end, w, role = words[i]
        if start < used or not role & (GIVEN | SURNAME):
            i += 1
            continue
        found = _grow(line, words, i, used)
        if found:
            a, b, terms = found
            used = b
            yield a, b, terms
            while i < n and words[i][0] < b:
                i += 1
        else:
            i += 1


def _next_name_word(line: str, words: list, i: int) -> int | None:
    """The next word after i that is neither an initial nor a particle, if what lies between belongs to a name."""
    j = i + 1
    while j < len(words):
        gap = line[words[i][1] : words[j][0]]
        w = words[j][2]
        if _GAP.fullmatch(gap) and not (_GAP.fullmatch(line[words[i][1] : words[j][1]] + " ") or len(w) == 1):
            return j
        if j > i + 5 or len(w) > 1 and not _GAP.fullmatch(line[words[i][1] : words[j][1]] + " "):
            return None  # a word that is no part of a particle: the name ends before it
        j += 1
    return None


def _grow(line: str, words: list, i: int, used: int) -> tuple[int, int, list[str]] | None:
    start, end, w, role = words[i]
    shape = _shape(w)
    if shape == "lower" and _PREFIX.match(w):
        shape = "title"
    fits = lambda x: _shape(x) == shape or shape == "title" and bool(re.match(r"[OD]['’]", x)) or shape == "upper" and x.isupper()
    if role & GIVEN:
        j = _next_name_word(line, words, i)
        if j is not None and fits(words[j][2]):
            nxt = words[j]
            if nxt[3] & SURNAME:
                k = _next_name_word(line, words, j)  # two surnames
                if k is not None and words[k][3] & SURNAME and not words[k][3] & GIVEN and line[nxt[1] : words[k][0]] == " " and fits(words[k][2]):
                    return start, words[k][1], [*terms_of(w), *terms_of(words[k][2])]
                return start, nxt[1], [*terms_of(w), *terms_of(nxt[2])]
            if nxt[3] & GIVEN and shape != "lower" and line[end : nxt[0]] == " ":  # two given names
                k = _next_name_word(line, words, j)
                if k is not None and words[k][3] & SURNAME and fits(words[k][2]):
                    return start, words[k][1], [*terms_of(w), *terms_of(words[k][2])]
    if role & SURNAME:
        if i + 1 < len(words):  # surname, given
            nxt = words[i + 1]
            if line[end : nxt[0]] == ", " and nxt[3] & GIVEN and (fits(nxt[2]) or nxt[2][:1].isupper() == w[:1].isupper()):
                k = _next_name_word(line, words, i + 1)
                begins_another = k is not None and words[k][3] & SURNAME and fits(words[k][2])
                if not begins_another:
                    return _from_particle(line, start), nxt[1], [*terms_of(w), *terms_of(nxt[2])]
        near, size = max(used, start - 60), 60
        initial = _INITIALS.search(line[near:start])
        while initial and near > used and initial.start() < 8:  # it may begin further to the left
            size *= 4
            near = max(used, start - size)
            initial = _INITIALS.search(line[near:start])
        if initial and shape != "lower":
            return near + initial.start(1), end, terms_of(w)
        if shape == "lower":
            return None
        return _from_particle(line, start), end, terms_of(w)
    if shape == "lower":
        return None
    gap = _back(line, start, " ,")
    prior = _GREETED.search(line[max(0, gap - 8) : gap]) if gap < start else None
    greeted = line[start - 1 : start] == "@" or prior and prior.group().lower() in _GREETING and _AFTER_GREETING.match(line, end)
    leaves = _LEAVES.match(line, end)
    if role & AMBIGUOUS and not greeted and not leaves:
        return None
    return start, end, terms_of(w)


_GREETED = re.compile(r"[^\W\d_]+$")  # greetings have at most seven letters
_AFTER_GREETING = re.compile(r"\s*[,!:.]|\s*$")
_LEAVES = re.compile(r" (?:has|had) (?:left|gone|moved|joined|asked|written)\b| is (?:away|out|back|on leave)\b")


def _from_particle(line: str, start: int) -> int:
    m = re.search(r"(?:^|(?<=\W))%s$" % _PARTICLE, line[max(0, start - 20) : start])
    return max(0, start - 20) + m.start() if m and m.group().strip() not in ("de", "la", "el", "le", "da", "do", "al", "den", "der", "du", "del", "zu") else start


def find(text: str | None, roles: _Roles) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, type, terms) of the entities of a text, in order and without overlaps."""
    if not text:
        return []
    called = roles.calling(set(text.split()))
    spans = [(a, b, kind, []) for kind, shape, own, a, b in _candidates(text, called) if _disclosed(text, kind, shape, own, a, b, roles)]
    for lo, hi in _lines(text, [t for t, w in called.items() if w & _CALL_NAME]):
        at = lo
        for line in text[lo:hi].split("\n"):
            spans += [(at + a, at + b, "name", terms) for a, b, terms in _names_of_line(line, roles)]
            at += len(line) + 1
    rank = {t: i for i, t in enumerate(TYPES)}
    kept = _Taken(len(text))
    return sorted(s for s in sorted(spans, key=lambda s: (rank[s[2]], s[0] - s[1], s[0])) if kept.add(s[0], s[1]))


def redacted(text: str | None, roles: _Roles) -> str | None:
    """The text with each entity replaced by the placeholder of its type."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind, _ in find(text, roles):
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def learn(spark: SparkSession, df: DataFrame, text: str, given: DataFrame, given_column: str) -> DataFrame:
    """The lexicon of a corpus, materialised."""
    return cut(disclosing_terms(spark, cut(count_terms(df, text)), given, given_column))


def mentions(spark: SparkSession, df: DataFrame, ident: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(ident, pii_type, pii_text, terms), each type and text once per document and row."""
    table = spark.sparkContext.broadcast(to_table(lexicon))  # 2 CELLS bytes
    kind = df.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roles = _Roles(table.value)
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["id"].tolist(), pdf["text"]):
                own = {}
                for start, end, what, terms in find(t, roles):
                    own.setdefault((what, t[start:end]), terms)
                rows += [(i, *k, terms) for k, terms in own.items()]
            yield pd.DataFrame(rows, columns=[ident, "pii_type", "pii_text", "terms"])

    rows = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text"))
    return spread(rows, "id").mapInPandas(run, f"{ident} {kind}, pii_type string, pii_text string, terms array<string>")


def confirmed(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mentions without the names that rest on a term the lexicon does not have."""
    terms = found.where(F.size("terms") > 0).select(F.explode("terms").alias("term")).distinct()
    wrong = terms.join(lexicon.where(F.col("roles").bitwiseAND(GIVEN | SURNAME) != 0), "term", "left_anti")
    bad = found.where(F.size("terms") > 0).select("pii_text", F.explode("terms").alias("term")).distinct().join(wrong, "term", "left_semi").select("pii_text", F.lit("name").alias("pii_type")).distinct()
    return found.join(bad, ["pii_type", "pii_text"], "left_anti")


def redact(spark: SparkSession, df: DataFrame, ident: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(ident, text) with placeholders."""
    table = spark.sparkContext.broadcast(to_table(lexicon))
    kind = df.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roles = _Roles(table.value)
        for pdf in frames:
            yield pd.DataFrame({ident: pdf["id"], "text": [redacted(t, roles) for t in pdf["text"]]})

    return spread(df.select(F.col(ident).alias("id"), F.col(text).alias("text")), "id").mapInPandas(run, f"{ident} {kind}, text string")

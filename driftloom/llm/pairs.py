"""Broken prompt and response pairs: empty, truncated, refusal, copy, other_language.

* copy: the normalised response is compressed twice, with its prompt as a zstandard dictionary and without. A response that offers nothing but
  its prompt nearly vanishes beside it; an exact count of the words that the prompt does not have confirms each candidate, since words in
  another order compress less well.
* refusal: a dictionary of refusing phrases by language; a refusal has one, and apart from it nothing but courtesies or referrals.
* other_language: the model of ``languages``, which learns from all prompts and responses that its dictionaries are sure of. The expected language is
  the one the question asks for, or the question's own; both languages must be known, and differ, for a label.
* truncated: the terminal-context model of ``truncation``. A copy or refusal without its last mark is no truncated one unless it breaks off openly.

Defined cases: a null prompt gives neither copy nor other_language; an empty response has no second defect; null keys are left out; repeated rows of a
key are one; texts are read whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.copies import WORDS as _WORDS
from driftloom.llm.copies import copies
from driftloom.llm.languages import language_of, script_of, train
from driftloom.llm.truncation import core_of, is_blank
from driftloom.session import cut, spread

# Names of languages as requests spell them.
LANGUAGE_NAMES = {
    "en": "english englisch inglés inglês anglais inglese engels",
    "de": "german deutsch alemán alemão allemand tedesco duits",
    "fr": "french französisch francés francês français francese frans",
    "es": "spanish spanisch español castellano espanhol espagnol spagnolo spaans",
    "pt": "portuguese portugiesisch portugués português portugais portoghese portugees",
    "it": "italian italienisch italiano italien italiaans",
    "nl": "dutch niederländisch neerlandés holandês néerlandais olandese nederlands",
    "ru": "russian russisch ruso russo russe русском",
    "ja": "japanese japanisch japonés japonês japonais giapponese japans",
    "zh": "chinese chinesisch chino chinês chinois cinese chinees",
}
# Phrases that refuse, by language, as patterns over lower-case text with plain apostrophes.
_ACT = r"(?:answer|comment|discuss|advise|help|assist|respond|reply|say anything|say more|go into|take a position|take (?:any )?questions|engage|provide|offer|share|give|weigh in|fulfil|comply|support|do that|do this|continue|speak|talk|write about|participate|make a statement|be answering|be able|be helping|recommend|express)"
_CANNOT = r"(?:can't|cannot|can not|could not|couldn't|won't|will not|would rather not|'d rather not|prefer not to|(?:am|'m|are|'re) (?:\w+ )?(?:not able to|unable to|not allowed to|not permitted to|not in a position to|not going to|not comfortable|not willing to)|do not|don't|must not|may not|have been (?:told|instructed|asked) not to|(?:isn't|is not) possible for (?:me|us) to|(?:wouldn't|would not) be (?:appropriate|right) for (?:me|us) to|have to refuse to|must decline to|decline to|refuse to|have no way to)"
REFUSALS = tuple(
    re.compile(p)
    for p in (
        rf"\b(?:i|we|it)\b ?{_CANNOT} (?:\w+ ){{0,2}}?{_ACT}\b",
        r"\b(?:i|we)(?: must| have to|'ll have to|'m going to)?(?: respectfully| politely)? (?:decline|refuse)(?: this| to| here| that| the request|\.|,|;|!|$)",
        r"\b(?:i|we)(?:'d| would)? ?(?:had |rather |better |prefer to |will |must |have to )*(?:pass on|refuse this|refuse that|decline this|skip this)\b",
        r"\b(?:falls? |lies? |is |be )?(?:outside of|outside|beyond) (?:what (?:i am|i'm|we are|we're) (?:allowed|permitted|able)|my abilities|my capabilities|my scope)",
        r"\b(?:is|are|would be) against (?:the|my|our) (?:rules|policy|policies|guidelines|instructions)\b",
        r"\b(?:guidelines|rules|policy|policies|instructions|safety settings) (?:(?:do not|don't|does not|doesn't|won't|will not) (?:let|allow|permit)|forbid|prohibit|prevent|stop|bar)s? ?(?:me|us|this|that|it)?\b",
        r"\b(?:i|we) (?:will|'ll|must|am going to|have to|'d better|will have to|'ll have to) (?:stop|leave it|leave this) (?:here|there|unanswered|at that)\b",
        rf"\b(?:this|that|it)(?: is not| isn't|'s not)(?: \w+)? (?:something|anything|a topic|a subject|a question|a matter)(?: that| which)? (?:i|we) (?:can|may|could|am able to|are able to|will|want to) (?:\w+ )?{_ACT}",
        r"\b(?:shall|will|can|could|may|must|do|have|has) (?:give |offer |provide |make |share |say )?no (?:answer|reply|comment|advice|opinion|response|guidance)\b",
        r"\b(?:shall|may|must) not (?:\w+ )?(?:answer|speak|reply|tell|comment|say)\b",
        r"\b(?:this one is|that is|is hereby|must be) (?:declined|refused)\b",
        r"\bnot (?:feel )?(?:comfortable|permitted|allowed) (?:to )?(?:weigh|discuss|answer|comment|advis|help|shar|talk)\w*",
        r"\bdon't feel comfortable\b",
        r"\bas an? (?:ai|language model)\b.*\b(?:cannot|can't|decline|unable|not able|won't)\b",
        r"\b(?:kann|darf|möchte|werde|will) (?:ich |dir |ihnen |wir |hier |dazu |dabei |leider |da |darauf )*(?:keine|nichts?|nicht) (?:\w+ )*?(?:helfen|sagen|antworten|beantworten|geben|äußern|auskunft|beraten)",
        r"\bich (?:kann|darf|möchte|werde) (?:\w+ )*?(?:keine|nichts?|nicht) (?:\w+ )*?(?:helfen|sagen|antworten|beantworten|geben|äußern|beraten)",
        r"\b(?:no me está permitido|no tengo permitido|no voy a (?:responder|contestar|opinar|hablar|comentar))",
        r"\b(?:não me é permitido|não tenho permissão|não vou (?:responder|opinar|falar|comentar))",
        r"\b(?:je ne suis pas autorisée? à|il ne m'est pas permis|je ne (?:vais|veux) pas (?:répondre|commenter|en parler))",
        r"\b(?:es ist mir|mir ist es|das ist mir) (?:leider )?nicht (?:erlaubt|gestattet|möglich)",
        r"\b(?:non mi è permesso|non mi è consentito|non (?:voglio|intendo) rispondere)",
        r"\b(?:het is (?:mij|me) niet toegestaan|ik ga (?:hier|daar) niet op in)",
        r"\b(?:no puedo|no podemos|prefiero no|no debo|no me es posible|no estoy en condiciones de|me niego a) (?:\w+ )*?(?:ayudar|ayudarle|ayudarte|responder|contestar|opinar|decir|comentar|hablar|dar|entrar)",
        r"\b(?:je ne peux|je ne suis|je ne souhaite|nous ne pouvons|je ne dois|je préfère ne|je refuse|il m'est impossible)\b.*\b(?:répondre|aider|avis|dire|commenter|donner|discuter|mesure|prononcer)",
        r"\b(?:não posso|não podemos|prefiro não|não devo|não me é possível) (?:\w+ )*?(?:ajudar|responder|opinar|dizer|comentar|falar|dar)",
        r"\b(?:non posso|non possiamo|preferisco non|non sono in grado di|mi dispiace, non) (?:\w+ )*?(?:aiutar\w*|risponder\w*|dir\w*|commentare|dare|parlare|esprimer\w*)",
        r"\b(?:ik kan|ik mag|ik wil|wij kunnen) (?:\w+ )*?(?:niet|niets|geen) (?:\w+ )*?(?:helpen|zeggen|antwoorden|beantwoorden|geven|ingaan)",
        r"(?:не могу|не можем|не буду|вынужден\w* отказать)\s?(?:\w+ )*?(?:помочь|ответить|отвечать|сказать|комментировать|обсуждать|обсудить)",
        r"(?:お答えできません|答えられません|お手伝いできません|お応えできません|回答できません|ご遠慮|お断り)",
    )
)
# Words of courtesies and referrals that may stand beside a refusal.
_COURTESY = re.compile(
    r"\b(?:sorry|apolog\w+|regret\w*|unfortunately|hope you understand|understand why|thank you|thanks|patience|another question|other question|anything else|something else|else (?:i|we) can|gladly|happy to|elsewhere|expert|experts|professional|specialist|library|local club|someone qualified|consult|point you|reach out|seek advice|not my place|best left|"
    r"fachperson|fachleute|wenden sie|tut mir leid|bitte|verständnis|lo siento|disculp\w+|profesional|especialista|consult\w+|otra pregunta|désolée?|professionnel|spécialiste|adressez|autre question|desculp\w+|lamento|profissional|outra pergunta|mi dispiace|professionista|esperto|het spijt|deskundige|helaas|извините|специалист\w*|申し訳|専門家)"
)
#: Something that every refusal has: a negation, or a word of declining. Sentences without it are not looked at further.
_NEGATION = re.compile(
    r"n't\b|\b(?:not|no|cannot|declin\w*|refus\w*|unable|pass|skip|beyond|outside|against|forbid\w*|prohibit\w*|prevent\w*|stops?|bars?|leave|comfortable|nicht|nichts?|keine?|ne|niego|não|non|niet|niets|geen|impossible)\b|\bn'|не\s|отказ|ません|遠慮|断り"
)
#: A longer sentence is looked at in pieces, each of which repeats the end of the one before.
LONGEST, OVERLAP = 2000, 400
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*|\n+")
_QUESTION = re.compile(r"(?:^|\n)\s*(?:question|frage|pregunta|pergunta|domanda|vraag|вопрос|質問|問題)\s*[:：]\s*", re.I)
_NAMED = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}
_REQUEST = re.compile(
    r"\b(?:answer|reply|respond|write|written|response|antworte\w*|antwort|schreib\w*|respond[ae]\w*|contest[ae]\w*|escrib\w*|répond\w*|écri\w*|respost\w*|escrev\w*|rispond\w*|scriv\w*|antwoord\w*|ответь\w*)\b[^.?!\n]{0,40}?\b("
    + "|".join(_NAMED)
    + r")\b",
    re.I,
)


def question_of(prompt: str) -> str:
    """What follows the last marker of a question, else the last paragraph."""
    marks = list(_QUESTION.finditer(prompt))
    if marks:
        return prompt[marks[-1].end() :].strip()
    return re.split(r"\n\s*\n", prompt.strip())[-1].strip()


def expected_language(prompt: str, model: np.ndarray) -> str | None:
    question = question_of(prompt)
    asked = list(_REQUEST.finditer(question))
    return _NAMED[asked[-1].group(1).lower()] if asked else language_of(question, model)


def other_language(prompt: str, core: str, model: np.ndarray, known: dict | None = None) -> bool:
    """``known`` keeps the expected language of prompts seen before."""
    known = {} if known is None else known
    if prompt not in known:
        if len(known) > 50_000:
            known.clear()
        known[prompt] = expected_language(prompt, model)
    want = known[prompt]
    got = language_of(core, model) if want else None
    return got is not None and want != got


def _pieces(sentence: str) -> Iterator[str]:
    """The sentence, or all of it in pieces of LONGEST characters that overlap by OVERLAP at least."""
    for at in range(0, max(len(sentence) - LONGEST, 0), LONGEST - OVERLAP):
        yield sentence[at : at + LONGEST]
    yield sentence[-LONGEST:]


def refuses(core: str) -> bool:
    text = core.lower().replace("’", "'")
    if not _NEGATION.search(text):
        return False
    refused, others = False, []
    for s in (p for x in _SENTENCE.split(text) if x for p in _pieces(x)):
        if _NEGATION.search(s) and any(p.search(s) for p in REFUSALS):
            refused = True
        else:
            others.append(s)
    if not refused:
        return False
    rest = 0
    for s in others:
        if s.strip() and not _COURTESY.search(s):
            rest += len(_WORDS.findall(s)) if not script_of(s) else len(s) // 2
    return rest <= 8


def label(response: str | None, prompt: str | None, model: np.ndarray, known: dict | None = None) -> list[str]:
    """The defects of one pair that show without the corpus."""
    if is_blank(response):
        return ["empty"]
    core, found = core_of(response)[0], []
    if refuses(core):
        found.append("refusal")
    if prompt and copies(prompt, core):
        found.append("copy")
    if prompt and "copy" not in found and other_language(prompt, core, model, known):
        found.append("other_language")
    return found


def own_defects(df: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """(key, defects) of every row that has any."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt"), F.col(response).alias("response"))
    rows = spread(rows, "key")
    model = train(rows, [F.col("prompt"), F.col("response")], (question_of, str))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for pdf in frames:
            found = [(k, d) for k, p, r in zip(pdf["key"], pdf["prompt"], pdf["response"]) for d in label(r, p, model, known)]
            yield pd.DataFrame(found, columns=["key", "defect"])

    return rows.mapInPandas(run, "key string, defect string")


def defects(df: DataFrame, judged: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """(key, defect), each once. ``judged``: the rows of ``truncation.truncated`` for the same table."""
    own = cut(own_defects(df, key, prompt, response).distinct())
    mild = own.where(F.col("defect") == "copy").select("key", F.lit(True).alias("_copy"))
    broken = judged.where("cut").select("key", "kind").join(mild, "key", "left").where(F.col("_copy").isNull() | (F.col("kind") == "open"))
    return own.unionByName(broken.select("key", F.lit("truncated").alias("defect"))).distinct()

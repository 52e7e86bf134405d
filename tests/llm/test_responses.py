import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import languages, pairs, truncation


@pytest.mark.parametrize(
    "text",
    [
        "It works best with the older ga",
        "One way to test it is to swap the",
        "First sentence. The second one ends here, and […]",
        "Then we stop (cut)",
        "A list:\n- one\n- two,",
        "Prose.\n\n```python\nx = 1\nprint(x",
        'He said "the first',
        "One of these is: (",
        "It works best with e.g.",
        "| a | b |\n| --- | --- |\n| x | 1",
        "| a | b |\n| --- | --- |\n| x |",
        "halfway through a wor�",
        "so the estación\\u00",
        "急ぐ人ほど時間を失います。古い記録が",
    ],
)
def test_broken_endings(text):
    assert not truncation.is_blank(text)
    kind = truncation.describe(text)[1]
    assert kind in ("open", "bare")


@pytest.mark.parametrize(
    "text",
    [
        "All done.",
        "Really?",
        'She said "measure first, argue later."',
        "(The same holds for moth traps.)",
        "Good luck with it 🙂",
        "Yes",
        "42",
        "```python\nprint(1)\n```",
        "| a | b |\n| --- | --- |\n| x | 1 |",
        "急ぐ人ほど時間を失います。",
        "No.",
        "It ended there. […]",
        "<p>done</p>",
        "the dogs said 'so it is'",
    ],
)
def test_whole_endings(text):
    assert truncation.describe(text)[1] in ("closed", "single")


@pytest.mark.parametrize("text", [None, "", " \n\t", "​", "﻿", "...", "…", "--", "?", "[]", "N/A", "null", "(blank)", " <empty> ", "<|endoftext|>", "[no response]", "Answer:"])
def test_blank_texts(text):
    assert truncation.is_blank(text) and pairs.label(text, "What now?", MODEL) == ["empty"]


MODEL = languages.to_model(languages.seed_counts())
NOUNS = ["budget", "gauge", "record", "sketch", "season", "valve"]
LONG = ["The numbers matter less than the order in which the {} is handled.", "Ask who pays if the {} turns out to be wrong.", "Start small and keep the {} nearby, then change one thing at a time."]


def responses(rng, n, limit):
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(LONG).format(rng.choice(NOUNS)) for _ in range(rng.randint(1, 9)))
        cut = len(text) > limit and i % 2 == 0
        rows.append((f"r{i}", text[:limit] if cut else text, cut))
    return rows


def test_cuts_at_a_limit_are_found_and_the_limit_is_significant(spark):
    rng = random.Random(11)
    rows = responses(rng, 1500, 240)
    rows += [(f"list{i}", f"{LONG[0].format('budget')} Check:\n- the {rng.choice(NOUNS)}\n- the {rng.choice(NOUNS)}", False) for i in range(30)]
    rows += [(f"sum{i}", " ".join(LONG[:k % 3 + 1]).format(*NOUNS) + " Summary: drop the rest", False) for i, k in enumerate(range(30))]
    rows += [("null", None, False), ("blank", " ", False), (None, "x", False)] + rows[:40]
    df = spark.createDataFrame([(k, t, "m", None) for k, t, _ in rows], "id string, text string, mode string, wc int").withColumn("kind", F.lit("clash"))
    feats = truncation.features(df, "id", "text", None, "wc", [F.col("mode")])
    limits = {(r.measure, r.length) for r in truncation.significant_lengths(feats, ["source_1"]).collect()}
    assert ("chars", 240) in limits
    found = [r.key for r in truncation.truncated(df, feats, "text", ["source_1"]).where("cut").collect()]
    assert len(found) == len(set(found))
    want = {k for k, t, cut in rows if cut and t.rstrip()[-1] not in ".?!"}
    wrong = {k for k in found if k not in want}
    assert not wrong and len(want - set(found)) <= 0.02 * len(want)
    shares = truncation.cut_shares(truncation.truncated(df, feats, "text", ["source_1"]), ["source_1"]).collect()
    assert len(shares) == 1 and shares[0].cut_texts == len(found)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id string, text string, prompt string, mode string")
    feats = truncation.features(df, "id", "text", "prompt", None, [F.col("mode")])
    cut = truncation.truncated(df, feats, "text", ["source_1"])
    assert cut.count() == 0 and truncation.significant_lengths(feats, ["source_1"]).count() == 0
    assert pairs.defects(df, cut, "id", "prompt", "text").count() == 0


PROMPT = "Role instruction:\nYou are a ferry pilot.\n\nQuestion:\nWhat do neighbours owe each other in matters of wool carding?"
ASKED = "What do neighbours owe each other in matters of wool carding?"


@pytest.mark.parametrize("text", [ASKED, ASKED.upper(), ASKED.lower().rstrip("?"), f'You asked: "{ASKED}"', f"Question: {ASKED}", f"{ASKED}\n{ASKED}", "What do neighbours each owe other in of matters carding? wool", PROMPT])
def test_copies(text):
    assert pairs.copies(PROMPT, text)


@pytest.mark.parametrize("text", ["They owe each other patience and a second reading of the log before anyone starts.", f"{ASKED} They owe each other patience, and a second look at the older gauge before anyone starts to judge.", "Yes", "wool"])
def test_answers_are_no_copies(text):
    assert not pairs.copies(PROMPT, text)


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry, but I can't help with that.",
        "Unfortunately, I have been told not to comment on moth traps here.",
        "I must respectfully decline. Questions like this should go to a professional.",
        "Lo siento, no puedo ayudar con eso.",
        "Tut mir leid, dabei kann ich nicht helfen.",
        "Je suis désolé, je ne peux pas répondre à cette question.",
        "That isn’t something I can assist with. Is there anything else you would like to talk about?",
        "My guidelines do not let me comment on this, so I will have to stop here.",
    ],
)
def test_refusals(text):
    assert pairs.refuses(text)


@pytest.mark.parametrize(
    "text",
    [
        "I can't claim that moth traps are easy, but it can be learned. Start small and keep the log nearby, then change one thing.",
        "I must decline the easy answer and give you the longer one. Measured over weeks, the difference was small and steady.",
        "Sorry to hear that; it sounds like a hard week, and there is still a way forward.",
        "No one can help with road salt better than the least experienced person, so ask for it first.",
        "I cannot stress enough how much the log matters here.",
        "Where the risk is honest, keep the log and drop everything that cannot be undone.",
    ],
)
def test_no_refusals(text):
    assert not pairs.refuses(text)


def test_languages_and_requests(spark):
    rows = [("Wie geht es den Leuten im Dorf mit der neuen Brücke und was sagen sie dazu?", None), ("The people of the village have not said what they think of the bridge.", None)]
    model = languages.train(spark.createDataFrame(rows, "a string, b string"), [F.col("a"), F.col("b")], (str, str))
    assert model.shape == (len(languages.LANGUAGES), languages.BUCKETS) and np.isfinite(model).all()
    german = "Man kann das nicht sagen, wenn die Leute im Dorf es noch nicht wissen und auch nicht fragen."
    assert languages.language_of(german, model) == "de" and languages.language_of("Yes", model) is None
    assert languages.language_of("В конце концов всё решает запасной план", model) == "ru"
    assert pairs.expected_language("Role instruction:\nDu bist ein Bote.\n\nQuestion:\nWhat is it? Answer in German.", model) == "de"
    assert not pairs.other_language("Question:\nWhat is it? Please reply in German.", german, model)
    assert pairs.other_language("Question:\nWhat do you think of the bridge, and what would they say?", german, model)
    quoted = f"They say \"{german}\" and that is what you would hear from the people of the village if you asked them."
    assert not pairs.other_language("Question:\nWhat do you think of the bridge, and what would they say?", quoted, model)


def test_defects_of_a_table(spark):
    rows = [
        ("a", PROMPT, None), ("a", PROMPT, None), ("b", PROMPT, ASKED.lower().rstrip("?")), ("c", PROMPT, "I'm afraid I can't comment on that; please ask el"), ("d", None, "Done."), ("e", PROMPT, "They owe patience. The first is \"the"), (None, PROMPT, ""), ("g", PROMPT, "They owe each other patience, and that is what the log is for."),
    ]
    df = spark.createDataFrame(rows, "id string, prompt string, text string").withColumn("defect", F.lit("clash"))
    feats = truncation.features(df, "id", "text", "prompt", None, [F.lit("s")])
    got = sorted((r.key, r.defect) for r in pairs.defects(df, truncation.truncated(df, feats, "text", ["source_1"]), "id", "prompt", "text").collect())
    assert got == [("a", "empty"), ("b", "copy"), ("c", "refusal"), ("c", "truncated"), ("e", "truncated")]


def test_very_long_texts_are_read_whole_and_quickly():
    long = "word " * 200_000 + " " * 200_000
    assert truncation.describe(long + "and then the")[1] == "bare" and not pairs.refuses(long + "I can't help with that.")
    assert pairs.refuses("I can't help with that. Thank you.") and pairs.copies(long, long[:50_000])
    assert languages.language_of("the people of the village " * 50_000, MODEL) == "en"


def ambiguous(spark):
    """Texts that end in words which whole texts end in as well, some of them at a limit of 200 characters."""
    rng, rows = random.Random(5), []
    for i in range(900):
        text = " ".join(rng.choice(LONG).format(rng.choice(NOUNS)) for _ in range(rng.randint(1, 6)))
        if i % 7 == 0:
            text = "Keep the rest of it nearby. " + text
        if i % 3 == 0 and len(text) > 230:
            head = text[:170].rsplit(" ", 1)[0]
            text = (head + " and so we drop the rest".rjust(200 - len(head), "x"))
        elif i % 5 == 0:
            text += " Summary: drop the rest"
        rows.append((f"r{i}", text, "m"))
    return spark.createDataFrame(rows, "id string, text string, mode string"), {k for k, t, _ in rows if len(t) == 200}


def test_limits_decide_where_endings_do_not(spark):
    df, at_limit = ambiguous(spark)
    feats = truncation.features(df, "id", "text", None, None, [F.col("mode")]).cache()
    limits = truncation.significant_lengths(feats, ["source_1"])
    with_, without = ({r.key: r.route for r in truncation.truncated(df, feats, "text", ["source_1"], x).where("cut").collect()} for x in (limits, limits.limit(0)))
    assert len(at_limit) > 20 and {k for k, route in with_.items() if route == "limit"} == at_limit
    assert not at_limit & set(without) and set(without) == {k for k, route in with_.items() if route == "transfer"}


def test_lengths_beside_a_limit_are_not_hidden_by_it(spark):
    rows = [("s", False, n, n, n) for n in range(1, 101) for _ in range(6)] + [("s", False, 100, 100, 100)] * 400 + [("s", False, 99, 99, 99)] * 60
    feats = spark.createDataFrame(rows, "source_1 string, blank boolean, chars int, core_chars int, words int")
    assert {r.length for r in truncation.significant_lengths(feats, ["source_1"]).collect()} == {99, 100}


def test_ends_are_looked_for_in_the_whole_text():
    filler = "the gauge is kept near the door. " * 400
    for opened in ("(", "["):
        assert truncation.describe(f"See {opened}as noted. {filler}")[1] == "open"
        assert truncation.describe(f"See {opened}as noted). {filler}")[1] == "closed"
    assert truncation.describe(f"Sad :( but true. {filler}")[1] == truncation.describe(f"In [0, 1) and a) b) too. {filler}")[1] == "closed"
    for n in (39, 40, 41, 400, 100_000):
        assert truncation.core_of("Then we stop" + "." * n + " \n") == ("Then we stop", True)
        assert truncation.core_of(f'Done. <p class="{"x" * n}">') == (f'Done. <p class="{"x" * n}">', False)
    word = "a" * 39
    assert truncation.describe(f"the {word}b")[3] == f"{word}b" and list(truncation.contexts(f"the {word}b"))[1][1] == f"{word}b"


def test_long_quotations_are_not_the_authors_language():
    german = "Man kann das nicht sagen, wenn die Leute im Dorf es noch nicht wissen und auch nicht fragen. " * 40
    assert languages.language_of(f"They say “{german}” and that is what you would hear from the people if you asked them.", MODEL) == "en"


def test_the_model_of_languages_is_fitted_on_a_bounded_sample(spark):
    rows = [("Wie geht es den Leuten im Dorf mit der neuen Brücke und was sagen sie dazu?",)] * 300
    whole, some = (languages.train(spark.createDataFrame(rows, "a string"), [F.col("a")], (str,), n) for n in (1000, 10))
    seed = languages.seed_counts()
    assert not np.allclose(whole, some) and not np.allclose(some, languages.to_model(seed))


def test_the_model_of_languages_is_of_all_texts(spark):
    rng = random.Random(6)
    german, english = "Man kann das nicht sagen wenn die Leute im Dorf es noch nicht wissen und auch nicht fragen".split(), "What do you think of the bridge and what would they say if the people of the village asked".split()
    texts = [" ".join(rng.choices(own, k=40)) for own in (german, english) for _ in range(15)]
    df = spark.range(41_000).select(F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 30 + 1).cast("int")).alias("a"))
    model = None
    for _ in range(2):
        counts = languages.seed_counts()
        for i, t in enumerate(texts):
            lang = languages.voted(languages._letters(t)) if model is None else languages.language_of(t, model, languages.SURE)
            if lang:
                counts[languages.LANGUAGES.index(lang)] += len(range(i, 41_000, 30)) * np.bincount(languages.trigrams(languages._letters(t)), minlength=languages.BUCKETS)
        model = languages.to_model(counts)
    assert np.array_equal(languages.train(df, [F.col("a")], (str,)), model)
    assert not np.array_equal(languages.train(df, [F.col("a")], (str,), 40_000), model)

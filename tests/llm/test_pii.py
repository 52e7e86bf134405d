import pytest
from pyspark.sql import functions as F

from driftloom.llm import pii

GIVEN = ["Agnes", "Will", "Priya", "Grace", "Tomas"]
FILLER = ["Will the rerun fit into the week?", "Grace periods are explained in the notes.", "Mark each row as late or kept.", "The Lighthouse Keeper and Ferry Pilot roles moved most.", "slice 863-11-4863 of the cursor", "The window covers 384-428-2048 in three slices.", "6281 2093 2810 are the three peaks", "recall@10 fell, mean_score@layer2.final too", "Compare checkpoint@step51 with checkpoint@step7.", "Std. over 54 Rows, Lane 6: 0.16", "2025-05-21T19:57:12Z INFO rows=4338 loss=1.80"]
CASES = {
    "Met with Agnes Korbmair and Zoltan Vellquist about it.": {("name", "Agnes Korbmair"), ("name", "Zoltan Vellquist")},
    "signed: Vellquist, Priya": {("name", "Vellquist, Priya")},
    "Dr. Tomas R. O’Korbmair signed off.": {("name", "Tomas R. O’Korbmair")},
    "Old labels by PRIYA KORBMAIR were kept.": {("name", "PRIYA KORBMAIR")},
    "Old labels by agnes vellquist's friend": {("name", "agnes vellquist")},
    "ask Zoltan de la Korbmair-Vellquist": {("name", "Zoltan de la Korbmair-Vellquist")},
    "Hi Zoltan, the payment has gone out.": {("name", "Zoltan")},
    "@Will please resend": {("name", "Will")},
    "G. Korbmair's notes": {("name", "G. Korbmair")},
    "write to agnes.k+runs@uni-hasel.example.": {("email", "agnes.k+runs@uni-hasel.example")},
    "mail to k_b [at] post [dot] mire [dot] test too": {("email", "k_b [at] post [dot] mire [dot] test")},
    "user=ab-12 at fern dot example action=x": {("email", "ab-12 at fern dot example")},
    "Contact: A.B@TALLOW.INVALID": {("email", "A.B@TALLOW.INVALID")},
    "Call +49 30 23125 670.": {("phone", "+49 30 23125 670")},
    "tel=+15575550121 step=5": {("phone", "+15575550121")},
    "Call (592) 555-0199 or phone 468-555-0102": {("phone", "(592) 555-0199"), ("phone", "468-555-0102")},
    "If nobody answers, call 0491 570 316.": {("phone", "0491 570 316")},
    "My SSN for the form is 903-61-6214.": {("id_number", "903-61-6214")},
    "passport XX3843431 and licence Q616-6042-2043": {("id_number", "XX3843431"), ("id_number", "Q616-6042-2043")},
    "NI number QQ 56 98 32 B here": {("id_number", "QQ 56 98 32 B")},
    "Lives at 217 Old Weir Blvd, Apt 16, Pike Hollow, QX 00072, works": {("address", "217 Old Weir Blvd, Apt 16, Pike Hollow, QX 00072")},
    "Flat 8, 46 Orchard End Road, Tallow Green QZ6 7XX": {("address", "Flat 8, 46 Orchard End Road, Tallow Green QZ6 7XX")},
    "Invoice, 121 Heron Way\nKestrelmouth 00018\nnext": {("address", "121 Heron Way\nKestrelmouth 00018")},
    "Lives at P.O. Box 66, Northfold 00029, works": {("address", "P.O. Box 66, Northfold 00029")},
    "lautet Alte Schleuse 217a, 00060 Niedermoorstadt.": {("address", "Alte Schleuse 217a, 00060 Niedermoorstadt")},
    "à 143 bis allée de la Tuilerie, 00051 Saint-Orme.": {("address", "143 bis allée de la Tuilerie, 00051 Saint-Orme")},
    "es C/ de las Colmenas 78, 1.º izq., 00065 Puerto Candil.": {("address", "C/ de las Colmenas 78, 1.º izq., 00065 Puerto Candil")},
}


def corpus():
    learn = [f"{g} {s} wrote on the list." for g in ("Agnes", "Tomas", "Zoltan", "Priya") for s in ("Korbmair", "Vellquist")] * 3
    learn += ["You can call +1 429 555 0172 in the mornings.", "Call +61 491 570 997.", "Please call +49 30 23125 670."] * 3
    learn += ["The form lists passport XX9843431.", "The form lists licence Q616-6042-2049."] * 4
    return learn + FILLER * 30 + list(CASES)


@pytest.fixture(scope="module")
def lexicon(spark):
    docs = spark.createDataFrame([(t,) for t in [*corpus(), None, ""]], "text string")
    given = spark.createDataFrame([(g,) for g in GIVEN], "given_name string")
    return pii.learn(spark, docs, "text", given, "given_name").cache()


def test_cases(lexicon):
    roles = pii._Roles(pii.to_table(lexicon, 1 << 16))
    for text, want in CASES.items():
        assert {(k, text[a:b]) for a, b, k, _ in pii.find(text, roles)} == want, text
    for text in [*FILLER, "", None, "x" * 100_000]:
        assert pii.find(text, roles) == [], text


def test_lexicon(lexicon):
    roles = {r.term: r.roles for r in lexicon.collect()}
    assert roles["korbmair"] & pii.SURNAME and roles["zoltan"] & pii.GIVEN and roles["will"] & pii.AMBIGUOUS
    assert roles["call"] & pii.NEAR_PHONE and "slice" not in roles and "ferry" not in roles


def test_mentions_and_redaction_of_a_table(spark, lexicon):
    rows = [(1, "Met Agnes Korbmair, Agnes Korbmair and a.b@c.example."), (2, None), (3, ""), (None, "Agnes Korbmair"), (4, "Met Agnes Korbmair."), (4, "Met Agnes Korbmair.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("terms", F.lit("clash"))
    found = pii.confirmed(pii.mentions(spark, df, "doc_id", "text", lexicon), lexicon).select("doc_id", "pii_type", "pii_text").distinct()
    assert sorted(map(tuple, found.collect())) == [(1, "email", "a.b@c.example"), (1, "name", "Agnes Korbmair"), (4, "name", "Agnes Korbmair")]
    clean = {r.doc_id: r.text for r in pii.redact(spark, df, "doc_id", "text", lexicon).collect()}
    assert clean[1] == "Met [NAME], [NAME] and [EMAIL]." and clean[2] is None and clean[3] == ""


def test_a_name_on_a_collision_is_not_confirmed(spark, lexicon):
    found = spark.createDataFrame([(1, "name", "Fake Name", ["fake"]), (2, "email", "a@b.example", [])], "doc_id long, pii_type string, pii_text string, terms array<string>")
    assert [r.doc_id for r in pii.confirmed(found, lexicon).collect()] == [2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    lexicon = pii.learn(spark, docs, "text", spark.createDataFrame([], "given_name string"), "given_name")
    assert pii.mentions(spark, docs, "doc_id", "text", lexicon).count() == 0


def test_very_long_lines(lexicon):
    roles = pii._Roles(pii.to_table(lexicon, 1 << 16))
    text = "Agnes Korbmair 12 345 a.b@c.example " * 20_000
    found = pii.find(text, roles)
    assert {(k, text[a:b]) for a, b, k, _ in found} == {("name", "Agnes Korbmair"), ("email", "a.b@c.example")}

from driftloom.llm import pairs, truncation


def test_limits_in_the_tail_are_held_against_pooled_hazards(spark):
    counts = [60, 55, 50, 45, 40, 36, 32, 28, 24, 20, 16, 12, 40]
    rows = [("s", False, n, n, n) for n, times in enumerate(counts, 1) for _ in range(times)]
    feats = spark.createDataFrame(rows, "source_1 string, blank boolean, chars int, core_chars int, words int")
    found = [r for r in truncation.significant_lengths(feats, ["source_1"]).collect() if r.measure == "words"]
    assert [(r.length, r.n, r.at_risk) for r in found] == [(13, 40, 40)]
    at_risk = [sum(counts[i:]) for i in range(len(counts))]
    assert abs(found[0].expected - 40 * sum(counts[:12]) / sum(at_risk[:12])) < 1e-9


def test_the_gate_lets_all_verbs_of_refusing_through():
    for verb in ("stops", "forbids", "prohibits", "prevents", "bars", "does not allow"):
        assert pairs.refuses(f"The policy {verb} me from answering this."), verb


def test_refusals_repeated_without_marks_are_refusals():
    loop = "i am sorry but i can't help with that request and "
    assert pairs.refuses(loop * 30) and pairs.refuses(loop * 60) and pairs.refuses(loop * 2000)
    assert not pairs.refuses(loop + "the log of the older gauge is kept near the door " * 100)
    for n in (1, 1999, 2000, 2001, 3600, 3601, 9000):
        text = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = list(pairs._pieces(text))
        assert pieces[0][0] == text[0] and pieces[-1][-1] == text[-1] and max(map(len, pieces)) <= pairs.LONGEST
        assert all(text.index(b[0]) <= text.index(a[-1]) + 1 - min(pairs.OVERLAP, len(a)) for a, b in zip(pieces, pieces[1:]))

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from driftloom.llm import ledger, mixing, packing, percentiles, spans, topn
from driftloom.llm.tokens import encoder, token_count

NAN, INF = float("nan"), float("inf")


# --- spans -------------------------------------------------------------------------------------------------------
def brute_pairs(rows, n):
    grams = defaultdict(set)
    for key, ids in rows:
        if key is not None and ids is not None:
            for i in range(len(ids) - n + 1):
                grams[tuple(ids[i : i + n])].add(key)
    return {p for keys in grams.values() for p in combinations(sorted(keys), 2)}, grams


def span_rows(seed):
    rng = random.Random(seed)
    common = [[rng.randrange(50) for _ in range(n)] for n in (31, 32, 33, 70)]
    rows = [("null", None), ("empty", []), (None, common[3]), ("short", common[0])]
    for i in range(60):
        ids = []
        for _ in range(rng.randrange(5)):
            ids += [rng.randrange(50) for _ in range(rng.randrange(20))] + (rng.choice(common) if rng.random() < 0.5 else [])
        rows.append((f"s{i}", ids))
    rows += [("zeros", [0] * 200), ("zeros2", [1] + [0] * 40), ("copy", common[3]), ("copy2", common[3]), ("s3", rows[7][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_coverage_equal_brute_force(spark, seed):
    rows = span_rows(seed)
    df = spark.createDataFrame(rows, "k string, ids array<int>").withColumn("key", F.lit("clash")).repartition(5)
    want, grams = brute_pairs(rows, 32)
    got = [(r.key_a, r.key_b) for r in spans.pairs(df, "k", "ids", 32).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    marks = defaultdict(set)
    for key, ids in rows:
        for i in range(len(ids or []) - 31):
            if key is not None and len(grams[tuple(ids[i : i + 32])]) > 1:
                marks[key].update(range(i, i + 32))
    covered = {r.key: r.shared_ids for r in spans.coverage(df, "k", "ids", 32).collect()}
    assert {k: n for k, n in covered.items() if n} == {k: len(m) for k, m in marks.items()}
    assert covered["null"] == covered["empty"] == 0


def brute_repeats(rows, n):
    texts = {(k, tuple(ids)) for k, ids in rows if k is not None and ids is not None}
    out = set()
    for (a, x), (b, y) in ((p, q) for p in texts for q in texts if p[0] < q[0]):
        for d in range(-len(y) + 1, len(x)):
            i = max(d, 0)
            while i < len(x) and i - d < len(y):
                j = i
                while j < len(x) and j - d < len(y) and x[j] == y[j - d]:
                    j += 1
                if j - i >= n:
                    out.add((a, i, b, i - d, j - i))
                i = max(j, i + 1)
    return out


@pytest.mark.parametrize("group", [2, 1000])
def test_repeats_and_classes_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(spans, "GROUP", group)
    rows = span_rows(3) + [("copy", [7] * 40), ("copy", span_rows(3)[7][1])]
    df = spark.createDataFrame(rows, "k string, ids array<int>").withColumn("at", F.lit("clash")).repartition(5)
    got = [tuple(r) for r in spans.repeats(df, "k", "ids", 32).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_repeats(rows, 32)
    texts = defaultdict(set)
    for k, ids in rows:
        texts[k].add(tuple(ids or ()))
    held = spans.classes(df, "k", "ids", 32).collect()
    by_class = defaultdict(list)
    for r in held:
        by_class[r["class"]].append(r)
    for own in by_class.values():
        assert len({r.key for r in own}) == own[0].records >= 2 and len({(r.n_ids, r.places) for r in own}) == 1
        spelled = [{t[r.start : r.start + r.n_ids] for t in texts[r.key] if len(t) >= r.start + r.n_ids} for r in own]
        assert set.intersection(*spelled)
    _, grams = brute_pairs(rows, 32)
    want = {(k, i) for k, own in texts.items() if k for t in own for i in range(len(t) - 31) if len(grams[t[i : i + 32]]) > 1}
    assert {(r.key, i) for r in held for i in range(r.start, r.start + r.n_ids - 31)} == want


def test_one_header_in_many_records(spark):
    n = 10_000
    head = list(range(100, 150))
    rows = spark.range(n).select(F.concat(F.lit("r"), "id").alias("k"), F.concat(F.array(*map(F.lit, head)), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: (F.xxhash64("id", i) % 1_000_000_007).cast("int"))).alias("ids"))
    held = spans.classes(rows, "k", "ids", 32)
    got = held.groupBy("class", "start", "n_ids", "records", "places").count().collect()
    assert [tuple(r)[1:] for r in got] == [(0, 50, n, n, n)]


def test_spans_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, ids array<int>")
    assert spans.pairs(df, "k", "ids", 32).count() == 0 and spans.coverage(df, "k", "ids", 32).count() == 0
    with pytest.raises(ValueError):
        spans.pairs(df, "k", "ids", 16)


def test_null_elements_are_ids(spark):
    a = [None, *range(40)]
    df = spark.createDataFrame([("a", a), ("b", [7, *a])], "k string, ids array<int>")
    assert spans.pairs(df, "k", "ids", 41).count() == 1


# --- ledger ------------------------------------------------------------------------------------------------------
PARTS = ("a", "b")


def keyed(spark, rows):
    return ledger.distinct_keys(spark.createDataFrame(rows, "a string, b long, extra int"), PARTS, 7)


def chosen(df):
    return {(r.a, r.b) for r in df.collect()}


def test_sample_is_stable_under_growth_and_layout(spark):
    rows = [(f"k{i % 400}", i % 3 if i % 5 else None, i) for i in range(2000)]
    first = ledger.grow(keyed(spark, rows[:500]), None, PARTS, 0.25, 7, 1)
    again = ledger.grow(keyed(spark, rows[:500][::-1] * 2).repartition(9), None, PARTS, 0.25, 7, 1)
    assert chosen(first) == chosen(again)
    grown = ledger.grow(keyed(spark, rows), first, PARTS, 0.25, 7, 2)
    assert chosen(first) <= chosen(grown)
    n = keyed(spark, rows).count()
    assert grown.count() == -(-n // 4)
    want = sorted((r.priority, r.a, r.b) for r in keyed(spark, rows).collect())
    fresh = [x for x in want if (x[1], x[2]) not in chosen(first)][: grown.count() - first.count()]
    assert chosen(grown) == chosen(first) | {(a, b) for _, a, b in fresh}


def test_ledger_keeps_vanished_keys_and_bears_empty_tables(spark):
    first = ledger.grow(keyed(spark, [("x", 1, 0), ("y", None, 0)]), None, PARTS, 1.0, 7, 1)
    later = ledger.grow(keyed(spark, []), first, PARTS, 1.0, 7, 2)
    assert chosen(later) == {("x", 1), ("y", None)}
    assert ledger.grow(keyed(spark, []), None, PARTS, 0.5, 7, 1).count() == 0


# --- percentiles -------------------------------------------------------------------------------------------------
def test_percentiles_keep_their_bound_and_merge(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.randrange(4), rng.choice([-1, 1]) * rng.lognormvariate(0, 6)) for _ in range(3000)]
    rows += [("a", 0, v) for v in (0.0, 0.0, -0.0, NAN, INF, -INF, None, 5e-300)] + [(None, 1, 2.5), ("only", 1, NAN)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    ps = [0, 0.1, 0.5, 0.9, 0.999, 1]
    whole = percentiles.percentiles(percentiles.sketch(df, ["g"], ["v"], 0.01), ["g"], ps, 0.01).collect()
    days = percentiles.merge(percentiles.sketch(df, ["g", "day"], ["v"], 0.01), ["g"])
    assert sorted(whole, key=str) == sorted(percentiles.percentiles(days, ["g"], ps, 0.01).collect(), key=str)
    values = defaultdict(list)
    for g, _, v in rows:
        if v is not None and abs(v) < INF:
            values[g].append(v)
    assert len(whole) == len(ps) * 4
    for r in whole:
        own = sorted(values[r.g])
        exact = own[int(r.p * (len(own) - 1))]
        assert r.n == len(own) and abs(r.estimate - exact) <= 0.01 * abs(exact) * (1 + 1e-9)


def test_sketch_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles.percentiles(percentiles.sketch(df, ["g"], ["v"], 0.01), ["g"], [0.5], 0.01).count() == 0


# --- top n -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 3, 10])
def test_top_n_equals_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([0.0, 1.0, 1.5, NAN, INF, None]), rng.choice([None, NAN, 1.0, 2.0]), i % 700) for i in range(1000)]
    rows += rows[:300]
    df = spark.createDataFrame(rows, "g string, s double, t double, i long").withColumn("score", F.lit(1)).repartition(7)

    def key(r):
        t = (1, 0.0) if r[2] is None else (0, -INF) if r[2] != r[2] else (0, -r[2])
        return (-r[1], t, r[3])

    want = {}
    for r in sorted((r for r in rows if r[0] is not None and r[1] is not None and abs(r[1]) < INF), key=key):
        own = want.setdefault(r[0], [])
        if r[3] not in own and len(own) < n:
            own.append(r[3])
    got = defaultdict(set)
    for r in topn.top_n_per_group(df, "g", ["s", "t"], "i", n).collect():
        got[r.g].add(r.i)
    assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x) for g, x in want.items()}
    assert topn.top_n_per_group(df.limit(0), "g", ["s", "t"], "i", n).count() == 0


def test_state_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame([("g", 1.0, None, i // 2) for i in range(20)], "g string, s double, t double, i long")
        assert sorted(r.i for r in topn.top_n_per_group(df, "g", ["s", "t"], "i", 4).collect()) == [0, 1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- packing -----------------------------------------------------------------------------------------------------
def test_fullest_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        space = rng.randint(0, 60)
        counts = {x: items.count(x) for x in items}
        got = packing.fullest(counts, sorted(counts, reverse=True), space)
        best = max(s for k in range(len(items) + 1) for c in combinations(items, k) if (s := sum(c)) <= space)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_everything_is_placed_whole(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 5, 60, 99, 100, 101, 250])) for i in range(500)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, n int").withColumn("bin", F.lit("clash"))
    placed = packing.place(df.fillna({"n": 0}), "id", "n", 100, 120).collect()
    by_item, by_bin = defaultdict(list), defaultdict(int)
    for r in placed:
        by_item[r.id].append((r.piece, r.n_tokens))
        by_bin[r.round, r.block, r.bin] += r.n_tokens
    assert max(by_bin.values()) == 100 and set(by_item) == {i for i, _ in rows}
    for i, n in rows:
        pieces = sorted(by_item[i])
        assert sum(p[1] for p in pieces) == (n or 0) and [p[0] for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == max(1, -(-(n or 0) // 100))
    again = packing.place(df.fillna({"n": 0}).repartition(6), "id", "n", 100, 120).collect()
    assert sorted(placed) == sorted(again)
    assert packing.place(df.limit(0), "id", "n", 100).count() == 0
    fill = packing.fill_report(packing.place(df.limit(0), "id", "n", 100), 100).collect()[0]
    assert fill.bins == 0 and fill.fill is None


def test_fill_does_not_fall_with_more_blocks(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, min(400, int(rng.lognormvariate(4, 1)))) for i in range(3000)], "id long, n int").cache()
    bins = {k: packing.fill_report(packing.place(df, "id", "n", 300, k), 300).collect()[0] for k in (500, 100_000)}
    assert len({r.tokens for r in bins.values()}) == 1 and all(r.bins <= r.least_bins + 1 for r in bins.values())


def test_items_that_fill_no_bin_are_placed_however_many_blocks_they_make(spark):
    df = spark.range(660).select("id", F.when(F.col("id") < 600, 60).otherwise(35).alias("n"))
    placed = packing.place(df, "id", "n", 100, 8).collect()
    by_bin = defaultdict(list)
    for r in placed:
        by_bin[r.round, r.block, r.bin].append(r.n_tokens)
    assert sorted(r.id for r in placed) == list(range(660))
    assert Counter(map(tuple, map(sorted, by_bin.values()))) == {(35, 60): 60, (60,): 540}


def test_the_plan_takes_the_fullest_bin_each_time():
    rng = random.Random(8)
    for _ in range(100):
        counts = {s: rng.randint(1, 40) for s in rng.sample(range(1, 31), rng.randint(1, 12))}
        left = dict(counts)
        for own, times in packing.plan(counts, 30):
            for _ in range(times):
                first = max(s for s, n in left.items() if n)
                left[first] -= 1
                most = sum(packing.fullest(left, sorted((s for s, n in left.items() if n), reverse=True), 30 - first))
                left[first] += 1
                assert own.get(first) and sum(s * n for s, n in own.items()) == first + most <= 30
                left = {s: n - own.get(s, 0) for s, n in left.items()}
                assert min(left.values()) >= 0
        assert not any(left.values())
    assert len(packing.plan({s: 10**9 for s in range(1, 101)}, 100)) < 1000  # grows with the lengths only


def test_token_count_equals_the_tokenizer(spark):
    texts = [None, "", " ", "a  b\n\n c", "<|endoftext|>", "日本語 é's", "x" * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(token_count("t").alias("n")).collect()
    enc = encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert [r.n for r in got] == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


# --- mixing ------------------------------------------------------------------------------------------------------
def test_sainte_lague_equals_the_plain_rule():
    rng = random.Random(6)
    for _ in range(100):
        weights = {k: rng.randint(0, 50) for k in "abcdef"}
        caps = {k: rng.randint(0, 40) for k in weights} if rng.random() < 0.5 else None
        seats, won = rng.randint(0, 120), dict.fromkeys([k for k, w in weights.items() if w], 0)
        for _ in range(seats):
            free = [k for k in won if not caps or won[k] < caps[k]]
            if free:
                won[max(free, key=lambda k: (weights[k] / (2 * won[k] + 1), -ord(k)))] += 1
        got = mixing.sainte_lague(weights, seats, caps)
        assert sum(got.values()) == sum(won.values())
        if not caps:
            assert got == won


def test_mix_reaches_targets_and_respects_repeats(spark):
    rng = random.Random(8)
    rows = [(i, f"text {i} " + "word " * rng.randint(1, 40), rng.choice(["Big", "big ", "big", "small-one", "other"]) if i % 10 else "small_one") for i in range(900)]
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(50)] + [(3000, None, "big"), (3001, "", "big"), (3002, "x", None)]
    docs = spark.createDataFrame(rows, "id long, text string, source string").withColumn("shard", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    texts = mixing.texts_of(docs, "id", "text", "source")
    mixed = mixing.mix(spark, texts, targets, shard_tokens=4000)
    report = {r.source: r for r in mixing.share_report(mixed, targets).collect()}
    assert abs(report["big"].actual_share - 5 / 9) < 0.01 and abs(report["small_one"].actual_share - 4 / 9) < 0.01
    assert report["absent"].tokens == 0 and report["big"].most_uses == 1 and report["small_one"].most_uses <= 3
    taken = mixed.collect()
    assert len({r.text_id for r in taken}) == len(taken)
    again = mixing.mix(spark, mixing.texts_of(docs.repartition(7), "id", "text", "source"), targets, shard_tokens=4000)
    assert sorted(map(str, taken)) == sorted(map(str, again.collect()))
    assert mixing.mix(spark, texts.limit(0), targets).count() == 0


def test_the_cut_is_the_same_through_finer_cells(spark, monkeypatch):
    keys = keyed(spark, [(f"k{i}", i, i) for i in range(300)]).cache()
    want = sorted(r.priority for r in keys.collect())
    for ranked in (1, 1_000_000):
        monkeypatch.setattr(ledger, "RANKED", ranked)
        for quota in (0, 1, 137, 300, 500):
            assert sorted(r.priority for r in ledger.lowest(keys, quota).collect()) == want[:quota]


def test_a_ledger_on_disk_is_read_by_the_next_run(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), [(f"k{i}", i % 7, i) for i in range(600)]
    assert ledger.load(spark, path) is None
    ledger.extend(keyed(spark, rows[:200]), path, PARTS, 0.3, 7, 1)
    first = chosen(ledger.load(spark, path))
    assert len(first) == 60
    ledger.extend(keyed(spark, rows[:5]), path, PARTS, 0.3, 7, 1)  # is there already
    assert chosen(ledger.load(spark, path)) == first
    ledger.extend(keyed(spark, rows), path, PARTS, 0.3, 7, 2)
    later = {(r.a, r.b): r.generation for r in ledger.load(spark, path).collect()}
    assert len(later) == 180 and {k for k, g in later.items() if g == 1} == first and ledger.generations(spark, path) == [1, 2]
    (tmp_path / "ledger" / "part_2" / "_SUCCESS").unlink()  # a part that broke off
    assert chosen(ledger.load(spark, path)) == first
    ledger.extend(keyed(spark, rows), path, PARTS, 0.3, 7, 2)
    assert {(r.a, r.b): r.generation for r in ledger.load(spark, path).collect()} == later
    with pytest.raises(ValueError):
        ledger.extend(keyed(spark, rows), path, PARTS, 0.3, 7, 0)


def test_the_sample_query_keeps_the_ledger_that_the_session_names(spark, tmp_path):
    from driftloom.llm import queries

    spark.conf.set(queries.LEDGER_FOLDER, str(tmp_path))
    try:
        first = queries.p5_sample(spark, "/root/testdata/sf0.001").collect()
        written = sorted(p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet"))
        assert sorted(map(str, queries.p5_sample(spark, "/root/testdata/sf0.001").collect())) == sorted(map(str, first))
        assert sorted(p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")) == written
    finally:
        spark.conf.unset(queries.LEDGER_FOLDER)


def test_percentile_queries_keep_their_bound_at_any_size(spark, tmp_path):
    from driftloom.llm import queries

    rng = random.Random(2)
    rows = [("w", rng.choice([-1, 1]) * v * rng.uniform(1, 2), v * 3.3) for v in (1e-9, 1e-12, 3e-7, 1.0, 1e9, 1e15) for _ in range(50)]
    spark.createDataFrame(rows, "window_id string, local_aa_score double, loss double").write.parquet(str(tmp_path / "gradient_scores.parquet"))
    for r in queries.p6_percentiles(spark, str(tmp_path)).collect():
        own = sorted(x[1 if r.metric == "local_aa_score" else 2] for x in rows)
        exact = own[int(r.p * (len(own) - 1))]
        assert abs(r.estimate - exact) <= queries.ALPHA * abs(exact), (r, exact)

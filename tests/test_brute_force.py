"""Distributed algorithms against plain loops on small random inputs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.functions.similarity import lcs_length
from gleaner.operators import dedup, html, jobs, quota
from gleaner.streaming import streams


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    a, b = a.lower(), b.lower()
    return 2 * table_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40))
@settings(max_examples=300, deadline=None)
def test_lcs(a, b):
    assert lcs_length(a, b) == table_lcs(a, b)


def noisy_values(seed, n):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcde ") for _ in range(rng.randint(3, 24))) for _ in range(8)]
    out = []
    for _ in range(n):
        s = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(s) + 1)
            if rng.random() < 0.5 and s:
                del s[min(k, len(s) - 1)]
            else:
                s.insert(k, rng.choice("abcdeF"))
        out.append("".join(s))
    return out


def greedy(values, threshold, keep):
    """Positions that survive."""
    gone = set()
    for i, a in enumerate(values):
        if i in gone:
            continue
        for j in range(i + 1, len(values)):
            if j not in gone and ratio(a, values[j]) >= threshold - 1e-12:
                if keep == "last":
                    gone.add(i)
                    break
                gone.add(j)
                if keep == "none":
                    gone.add(i)
    return {i for i in range(len(values)) if i not in gone}


@pytest.mark.parametrize("threshold, keep", [(0.9, "first"), (0.6, "first"), (0.8, "last"), (0.8, "none")])
def test_fuzzy_dedup(spark, threshold, keep):
    values = noisy_values(int(threshold * 10), 60)
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v string")
    got = {r["id"] for r in dedup.fuzzy_dedup(df, "id", ["v"], threshold, keep).collect()}
    assert got == greedy(values, threshold, keep)


def test_narrow_rounds_agree(spark):
    """The width of a round changes the number of rounds, not the result."""
    values = sorted({v.lower() for v in noisy_values(5, 80)})
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, value string")
    heads, members = dedup.leaders(df, "id", 0.8, width=2, assign=True)
    kept = greedy(values, 0.8, "first")
    assert {r["id"] for r in heads.collect()} == kept
    for r in members.collect():
        assert r["leader"] == min(k for k in kept if ratio(values[k], values[r["id"]]) >= 0.8 - 1e-12)


@pytest.mark.parametrize("threshold", [0.9, 0.75, 0.5])
def test_similar_pairs_miss_none(spark, threshold):
    values = noisy_values(11, 50)
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v string")
    got = {(r["value_a"], r["value_b"]) for r in dedup.similar_pairs(df, "id", "v", threshold).collect()}
    low = [v.lower() for v in values]
    want = {tuple(sorted((a, b))) for i, a in enumerate(low) for b in low[:i] if ratio(a, b) >= threshold - 1e-12}
    assert got == want


def test_hot_group_of_copies(spark):
    """A third of all rows near copies of one text: every one of them goes but the first."""
    base = "the quick brown fox jumps over the lazy dog again and again"
    values = [base + f" {i % 7}" for i in range(200)] + noisy_values(3, 40)
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v string")
    got = {r["id"] for r in dedup.fuzzy_dedup(df, "id", ["v"], 0.9).collect()}
    assert got == greedy(values, 0.9, "first")


def test_similar_value_groups(spark):
    values = ["Apple Inc", "apple inc", "Apple Inc.", "Banana", "banana!", "none", "", "Cherry"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {(r["canonical"], r["member"]) for r in dedup.similar_value_groups(df, "v").collect()}
    assert got == {("Apple Inc", "apple inc"), ("Apple Inc", "Apple Inc."), ("Banana", "banana!")}


def test_near_duplicate_texts(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choice(words) for _ in range(200))
    texts = [base, base + " tail", "head " + base, base, " ".join(rng.choice(words) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {(r["id"], r["leader"], r["copies"]) for r in dedup.near_duplicate_texts(df, "id", "text").collect()}
    assert got == {(0, 0, 2), (1, 0, 1), (2, 0, 1)}


def events(spark, seed, n=400):
    rng = random.Random(seed)
    rows = sorted((rng.choice("aab"), rng.randrange(5000)) for _ in range(n))
    data = [(i, p, t) for i, (p, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "id bigint, pool string, s bigint").selectExpr("id", "pool", "s", "timestamp_seconds(s) as ts")
    return data, df


def by_pool(data):
    out = {}
    for i, p, t in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(p, []).append((i, t))
    return out


def admitted_ids(data, limit, window):
    ok = set()
    for requests in by_pool(data).values():
        seen = []
        for i, t in requests:
            seen = [s for s in seen if t - s <= window]
            if len(seen) < limit:
                seen.append(t)
                ok.add(i)
    return ok


def test_admission(spark):
    data, df = events(spark, 2)
    got = {r["id"] for r in quota.admitted(df, "pool", "ts", "id", 3, 60).filter("admitted").collect()}
    assert got == admitted_ids(data, 3, 60)


def test_cache(spark):
    data, df = events(spark, 3)
    want = set()
    for requests in by_pool(data).values():
        expires = None
        for i, t in requests:
            if expires is None or expires <= t:
                want.add(i)
                expires = t + 50
    assert {r["id"] for r in quota.cached(df, "pool", "ts", "id", 50).filter("fetched").collect()} == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_rolling_count(spark, inclusive):
    data, df = events(spark, 4)
    got = {r["id"]: r["requests"] for r in quota.rolling_count(df, "pool", "ts", 30, inclusive).collect()}
    reach = 30 if inclusive else 29.5
    assert got == {i: sum(1 for _, q, u in data if q == p and 0 <= t - u <= reach) for i, p, t in data}


def test_streams_equal_batches(spark, tmp_path):
    data, df = events(spark, 6)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.read_stream(spark, f"{tmp_path}/in", "*.parquet", df.schema)
    out = streams.run_to_files(streams.admitted(stream, "pool", "ts", ["id"], 3, 60), f"{tmp_path}/a")
    assert {r["id"] for r in out.filter("admitted").collect()} == admitted_ids(data, 3, 60)
    stream = streams.read_stream(spark, f"{tmp_path}/in", "*.parquet", df.schema)
    out = streams.run_to_files(streams.cached(stream, "pool", "ts", ["id"], 50), f"{tmp_path}/c")
    batch = quota.cached(df, "pool", "ts", "id", 50)
    assert {tuple(r) for r in out.select("id", "fetched").collect()} == {tuple(r) for r in batch.select("id", "fetched").collect()}


def test_chunks_over_several_batches(spark, tmp_path):
    df = spark.range(1000).withColumnRenamed("id", "n")
    df.repartitionByRange(5, "n").write.parquet(f"{tmp_path}/in")
    stream = streams.read_stream(spark, f"{tmp_path}/in", "*.parquet", df.schema, files_per_batch=2)
    progress = streams.process_chunks(stream, ["n"], f"{tmp_path}/out", lambda d: d, 300, max_items=900)
    whole = progress.groupBy("chunk").agg({"chunk_size": "sum"}).collect()
    assert {r[0]: r[1] for r in whole} == {0: 300, 1: 300, 2: 300}
    assert spark.read.parquet(*[f"{tmp_path}/out/results/{i}" for i in range(3)]).count() == 900


def test_failing_chunk_is_reported(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")

    def broken(_df):
        raise ValueError("bad chunk")

    stream = streams.read_stream(spark, f"{tmp_path}/in", "*.parquet", spark.range(1).schema)
    progress = streams.process_chunks(stream, ["id"], f"{tmp_path}/out", broken, 4).collect()
    assert {r["status"] for r in progress} == {"error"} and {r["error"] for r in progress} == {"bad chunk"}


def test_index_is_a_total_order(spark):
    rng = random.Random(9)
    keys = rng.sample(range(10000), 2000)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(7)
    got = jobs.with_index(df, ["k"], "i").collect()
    assert {r["k"]: r["i"] for r in got} == {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("n", [0, 1, 2, 999, 1000])
def test_median(spark, n):
    import statistics

    from gleaner.operators.profile import exact_median

    rng = random.Random(n)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = statistics.median(values) if values else None
    assert exact_median(df, "v") == want and exact_median(df, "v", small=10) == want


def test_domain_lists_short_and_long(spark):
    from gleaner.operators.contacts import filter_domains

    emails = ["a@x.org", "b@mail.x.org", "c@y.com", "d@org", "nobody"]
    df = spark.createDataFrame([(e,) for e in emails], "email string")
    for in_row in (0, 64):
        kept = {r["email"] for r in filter_domains(df, ["X.org", "com"], in_row=in_row).collect()}
        assert kept == {"a@x.org", "b@mail.x.org", "c@y.com"}
        assert {r["email"] for r in filter_domains(df, ["X.org", "com"], True, in_row).collect()} == {"d@org"}


def test_next_pages_in_a_loop(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "url string, target string")
    starts = spark.createDataFrame([("a",), ("x",)], "url string")
    got = {tuple(r) for r in html.next_page_chains(links, starts, 7).collect()}
    loop = "abcabca"
    assert got == {("a", i, u) for i, u in enumerate(loop)} | {("x", 0, "x"), ("x", 1, "y")}

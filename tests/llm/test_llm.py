"""The document operators against brute force, exact round trips, and their edge cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lineguard.llm import fingerprints, language, mixing, packing, queries, simhash, token_counts, toxicity, url_filter, vectors, warc
from lineguard.llm.common import load, remainder, sampled_rows
from lineguard.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "don't  we're\n\n x", "a<|endoftext|>b !!<|startoftext|>", "x²½ 12 \x85\x1c\xa0 日本語 Σ ΑΣ", "İstanbul éé ß", "a" * 500, "\U0001f600'll"]


@pytest.fixture(scope="module")
def docs(spark):
    return load(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (3, ODD[3]), (20, None), (None, "some words here"), (None, None), (21, ODD[2])]
    names = "doc_id long, text string, lang string, source string, n_chars long, topic string, kept string, tokens int, fingerprint_bits string, component_id string"
    return spark.createDataFrame([(i, t, "en" if t else None, None, len(t or ""), "x", "y", 1, "f", "c") for i, t in rows], names)


# -- fingerprints


def _edited(ids, texts):
    for i, d in enumerate(ids):
        t, follower = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        yield d, t[: len(t) - half] + follower[:half]


def test_fingerprints_edit_whole_texts(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op1_weighted_fingerprints(spark, SF).collect()}
    assert set(rows) == set(texts)
    ids = sorted(texts)
    for d, edited in _edited(ids, texts):
        assert rows[d]["n_chars"] == len(texts[d])
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {}
    for d in ids:
        assert by_text.setdefault(texts[d], rows[d]["fingerprint"]) == rows[d]["fingerprint"]
    part = lambda s: [s[i : i + fingerprints.DIGITS] for i in range(0, len(s), fingerprints.DIGITS)]
    for a, b in zip(ids, ids[1:] + ids[:1]):
        same = np.mean([x == y for x, y in zip(part(rows[a]["fingerprint"]), part(rows[b]["fingerprint"]))])
        assert rows[a]["near_next"] == pytest.approx(same)


def test_collision_rate_is_the_generalised_jaccard(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    a, b = rng.integers(0, 4, 60), rng.integers(0, 4, 60)
    lines = [" ".join(w for w, n in zip(words, v) for _ in range(n)) for v in (a, b)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, text string")
    many = 600
    one, two = (r["signature"] for r in fingerprints.signatures(df, ["k"], "text", many).orderBy("k").collect())
    assert np.mean(np.array(one) == np.array(two)) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.07)


def test_likenesses_have_a_standard_error_below_nine_hundredths(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    lengths = {len(r["fingerprint"]) for r in fingerprints.fingerprint_edits(df).collect()}
    assert lengths == {fingerprints.SAMPLES * fingerprints.DIGITS} and 0.5 / fingerprints.SAMPLES**0.5 < 0.09


@pytest.mark.parametrize("rows_per_range", [3, 4000])
def test_next_document_across_ranges(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(fingerprints, "ORDERED_ROWS", rows_per_range)
    df = spark.createDataFrame([(7 * i % 31, f"t{7 * i % 31}") for i in range(31)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.ordered(df, "doc_id", "text").collect()}
    assert got == {i: f"t{(i + 1) % 31}" for i in range(31)}


# -- token counts


def test_counts_of_every_prefix():
    own = token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(own.library.encode(t, add_special_tokens=False).ids)
    for t in ODD:
        at = token_counts.counts(own.stores([t])[0])
        assert at[-1] == count(t)
        if len(own.normal(t)) == len(t):
            assert at.tolist() == [count(t[:i]) for i in range(len(t) + 1)]
    store = own.stores(["one two three four"])[0]
    assert token_counts.longest_prefix(store, 2) == len("one two ")


def test_token_counts_of_whole_texts(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.op4_token_counts(spark, SF).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


# -- SimHash and components


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_links_all_within_two_bits(spark, texts):
    prints = {d: _fingerprint(t) for d, t in texts.items()}
    lowest = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and lowest[b] < lowest[a]:
                    lowest[a], changed = lowest[b], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", lowest[d]) for d in prints}


@pytest.mark.parametrize("segments", [4, 10, 12])
def test_range_join_finds_every_close_pair_once(spark, segments):
    rng = np.random.default_rng(segments)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 30)]
    near = {x ^ sum({1 << int(k) for k in rng.choice(63, n, replace=False)}) for x in base for n in (1, 2, 3, 4)}
    bits = sorted({*base, *near, 0, -1, 1})
    df = spark.createDataFrame([(b,) for b in bits], "bits long")
    got = Counter(tuple(sorted(r)) for r in simhash.links(df, segments=segments).collect())
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(bits) for b in bits[i + 1 :] if ((a ^ b) & mask).bit_count() <= 2}
    assert set(got) == want and set(got.values()) <= {1}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 300: 300, 301: 300}


def _tasks(spark, group, run):
    """What *run* returns, and how many tasks its jobs had."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    at = spark.sparkContext.statusTracker()
    stages = {s for job in at.getJobIdsForGroup(group) for s in at.getJobInfo(job).stageIds}
    return out, sum(at.getStageInfo(s).numTasks for s in stages if at.getStageInfo(s))


def test_components_of_few_links_do_not_cost_a_task_for_each_shuffle_partition(spark, monkeypatch):
    links = [(i, i + 1) for i in range(20)] + [(30, 40 + i) for i in range(9)] + [(None, 5), (7, None), (8, 8), (1, 0)]
    wanted = {i: 0 for i in range(21)} | {30: 30} | {40 + i: 30 for i in range(9)}
    given = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    run = lambda: {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        got, few = _tasks(spark, "few links", run)
        monkeypatch.setattr("lineguard.llm.common.FEW_ROWS", -1)
        shuffled, many = _tasks(spark, "many links", run)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == shuffled == wanted
    assert few < 150 < many, (few, many)


def test_mixing_of_few_cells_does_not_cost_a_task_for_each_shuffle_partition(spark, docs, monkeypatch):
    given = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    run = lambda: {r["doc_id"]: (r["probability"], r["kept"]) for r in mixing.mix(docs).collect()}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        got, few = _tasks(spark, "few cells", run)
        monkeypatch.setattr("lineguard.llm.common.FEW_ROWS", -1)
        shuffled, many = _tasks(spark, "many cells", run)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {d: p for d, (p, _) in got.items()} == pytest.approx({d: p for d, (p, _) in shuffled.items()})
    assert {d: k for d, (_, k) in got.items()} == {d: k for d, (_, k) in shuffled.items()}
    assert few < many / 4, (few, many)


# -- embeddings


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    crowd = base[0] + 0.09 * rng.standard_normal((120, 16))
    rows = [*base, *crowd, *(base + 0.02 * rng.standard_normal(base.shape)), base[1], base[1], 3 * base[2]]
    data = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rows)]
    data += [(900, [0.0] * 16, 0), (901, None, 0), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None), (904, [1.0, None], 1), (905, [1.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    x = vectors.unit(np.array(rows))
    like = (x @ x.T >= 0.98) & (np.arange(len(rows))[:, None] % 2 == np.arange(len(rows)) % 2)
    np.fill_diagonal(like, False)
    low = np.arange(len(rows))
    for _ in rows:
        low = np.minimum(low, np.where(like, low, 10**6).min(axis=1))
    want = {i: (int(like[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(len(rows))}
    want |= {i: (0, i, True) for i in range(900, 906)}
    for options in ({}, {"shard_bytes": 40 * 16 * 8, "queries": 50}):
        got = {r[0]: tuple(r[1:]) for r in vectors.near_duplicates(df, **options).collect()}
        assert got == want
    assert vectors.near_duplicates(df.limit(0)).collect() == []
    clash = df.withColumns({c: F.lit("x") for c in ("key", "shard", "block", "rep", "n", "to", "root", "first")})
    assert {r[0]: tuple(r[1:]) for r in vectors.near_duplicates(clash).collect()} == want


def test_recall_in_crowds_of_a_full_shard():
    """Crowds of vectors most of which do not link to each other: few links are missed, none is made up."""
    rng = np.random.default_rng(1)
    n, dim = 3000, 16
    rows = rng.standard_normal((n, dim))
    free = rng.permutation(n)
    for size in (40, 100, 200, 600):
        crowd, free = free[:size], free[size:]
        rows[crowd] = rng.standard_normal(dim) + 0.18 * rng.standard_normal((size, dim))
    x = vectors.unit(rows)
    graph = vectors.Graph(x, 0.98)
    assert graph.audit() >= vectors.RECALL
    graph = vectors.Graph.load(graph.dump())
    want = x @ x.T >= 0.98
    found = np.zeros_like(want)
    for i, hits in enumerate(graph.search(x)):
        found[i, hits] = True
    assert not (found & ~want).any() and (found & want).sum() >= 0.99 * want.sum()


def test_sets_merge_to_their_smallest_member():
    sets = vectors.Union(8)
    for rows in ([5, 3], [7, 6], [3, 6], [1, 2]):
        sets.merge(np.array(rows))
    assert sets.roots(np.arange(8)).tolist() == [0, 1, 1, 3, 4, 3, 3, 3]


# -- WARC


def test_warc_round_trip(spark):
    big, other = "é" * 600, "y" * 2000
    rows = [(1, "http://a/", big), (2, None, big), (9, "http://b/", big), (4, "http://c/", "short"), (5, "http://c/", "short"), (6, "u", None), (7, "http://d/ x", other), (7, "http://d/ x", other), (None, "n", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, len((t or "").encode()), sha(t), "revisit" if t == big and i != 9 else "response", 9 if t == big and i != 9 else None) for i, _, t in rows]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_records_survive_any_chunking():
    raw = b"".join(warc.record(i, "http://x/", bytes(range(256)) * i, "00" * 20, None) for i in range(5))
    for step in (1, 7, 4096):
        parts = list(warc.records(raw[i : i + step] for i in range(0, len(raw), step)))
        assert b"".join(parts) == raw and len(parts) == 5
    with pytest.raises(ValueError):
        list(warc.records(iter([raw[:-3]])))


# -- URL filter


def test_entries_hold_from_their_day_to_the_next_change(spark):
    day = lambda d: f"2024-01-{d:02d}"
    changes = spark.createDataFrame(
        [("ads", "x.com", "c", day(5), True), ("ads", "x.com", None, day(10), False), ("ads", "x.com", "c", day(10), True), ("ads", "x.com", None, day(20), False), ("bad", "www.x.com", "c", day(7), True), (None, "x.com", "c", day(1), True)],
        "list string, rule string, category string, day string, added boolean",
    ).withColumn("day", F.col("day").cast("date"))
    captures = [(1, "http://www.X.com./a", day(4)), (2, "http://www.x.com", day(5)), (3, "https://u@www.x.com:8/", day(12)), (4, "http://www.x.com", day(20)), (5, "http://x.com.org", day(8)), (6, None, day(8)), (7, "no url", day(8)), (8, "http://x.com", None)]
    df = spark.createDataFrame(captures, "k int, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("host", F.lit("own"))
    got = {r["k"]: (r["_host"], r["hits"], r["lists"]) for r in url_filter.active_entries(df, url_filter.intervals(changes)).collect()}
    assert got == {
        1: ("www.x.com", 0, []), 2: ("www.x.com", 1, ["ads"]), 3: ("www.x.com", 2, ["ads", "bad"]), 4: ("www.x.com", 1, ["bad"]),
        5: ("x.com.org", 0, []), 6: ("", 0, []), 7: ("", 0, []), 8: ("x.com", 0, []),
    }


def test_hosts_of_many_labels_are_looked_up_whole(spark):
    deep = "a.b.c.d.e.f.g.h.x.com"
    changes = spark.createDataFrame([("ads", deep, "c", "2024-01-01", True), ("bad", deep[2:], "c", "2024-01-01", True)], "list string, rule string, category string, day string, added boolean")
    df = spark.createDataFrame([(1, f"http://{deep}/"), (2, f"http://{deep[2:]}/"), (3, f"http://z.{deep}/"), (4, "http://x.com/")], "k int, url string").withColumn("fetched", F.lit("2024-01-02").cast("date"))
    entries = url_filter.intervals(changes.withColumn("day", F.col("day").cast("date")))
    got = {r["k"]: r["lists"] for r in url_filter.active_entries(df, entries).collect()}
    assert got == {1: ["ads", "bad"], 2: ["bad"], 3: ["ads", "bad"], 4: []}
    clash = df.withColumns({c: F.lit("x") for c in ("__hits", "__lists", "__host", "__day", "hits", "salt", "rule")})
    doubled = url_filter.active_entries(clash.unionByName(clash), entries)
    assert sorted((r["k"], r["lists"]) for r in doubled.collect()) == sorted([*got.items()] * 2)
    assert url_filter.active_entries(df.limit(0), entries).collect() == []


# -- packing


def test_packing_is_an_exact_partition(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op9_packing(spark, SF).collect()
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for d, t in texts.items()}
    seen, fill = {d: np.zeros(len(v), int) for d, v in ids.items()}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"] > 0
        seen[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((s == 1).all() for s in seen.values())
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(v) for v in ids.values())
    assert total / (2048 * len(fill)) > 0.97


def test_patterns_hold_the_demand_near_the_bound():
    rng = np.random.default_rng(2)
    for trial in range(4):
        demand = Counter(int(x) for x in rng.integers(1, 513, 300 * 20**trial // 20 + 5))
        plan = packing.patterns(dict(demand), 512)
        got = Counter()
        for use, times in plan:
            assert sum(s * n for s, n in use.items()) <= 512
            for s, n in use.items():
                got[s] += n * times
        assert got == demand
    assert sum(t for _, t in plan) <= 1.02 * sum(s * n for s, n in demand.items()) / 512 + 1
    assert packing.patterns({}, 512) == [] and packing.patterns({512: 3}, 512) == [({512: 1}, 3)]


def test_encoder_equals_the_library():
    own = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.quick is not None
    for t in ODD:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == own.library.encode(t, add_special_tokens=False).ids


# -- language and toxicity


def test_language_on_held_out_documents(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = queries.op10_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_kernel_features_reproduce_landmark_kernels():
    rows = [("the cat sat on the mat", "a"), ("die katze sitzt auf der matte", "b"), ("a dog and a cat", "a"), ("der hund und die katze", "b")]
    model = language.fit(rows, landmarks=4)
    assert [model.languages[i] for i in model.scores([t for t, _ in rows]).argmax(axis=1)] == [y for _, y in rows]
    one, two = (set(language.grams(t)) for t in ("abab", "ab"))
    assert two < one and len(two) == len({"a", "b", " ", " a", "ab", "b ", " ab", "ab "})


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network.new()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, real, y, w = rng.standard_normal((5, 3, 2 * toxicity.VECTOR)), np.ones((5, 3)), np.array([0.0, 1, 1]), np.array([1.0, 2, 1])
    real[4, 1] = 0

    def loss():
        s = toxicity._sigmoid(net.forward(x, real)[0])
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum()

    g, _ = net.gradients(x, real, y, w)
    for k, value in g.items():
        at = tuple(int(rng.integers(0, n)) for n in value.shape)
        kept = net.p[k][at]
        net.p[k][at] = kept + 1e-3
        up = loss()
        net.p[k][at] = kept - 1e-3
        down = loss()
        net.p[k][at] = kept
        assert (up - down) / 2e-3 == pytest.approx(value[at], abs=2e-4), k


def test_training_holds_little_beside_its_sample():
    import tracemalloc

    rng = np.random.default_rng(1)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (64_000, 9))]
    texts = [" ".join(words[100 * k : 100 * k + 100]) for k in range(640)]
    tracemalloc.start()
    try:
        toxicity.train(texts, [k % 2 for k in range(640)], epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6, peak  # 640 KB of text, 64,000 words


def test_toxicity_finds_rude_windows_anywhere():
    rng = np.random.default_rng(4)
    clean = [f"w{i}" for i in range(300)]
    make = lambda bad: [*rng.choice(clean, 200), *(["nasty", "vile"] * 2 if bad else []), *rng.choice(clean, int(rng.integers(0, 300)))]
    train = [(" ".join(make(k % 2)), k % 2) for k in range(160)]
    scorer = toxicity.Scorer(toxicity.train([t for t, _ in train], [y for _, y in train]))
    test = [(" ".join(make(k % 2)), k % 2) for k in range(60)]
    got = scorer.scores([t for t, _ in test]) >= 0.5
    assert np.mean(got == np.array([y for _, y in test])) >= 0.95
    assert ((scorer.scores([None, "", "x"]) >= 0) & (scorer.scores([None, "", "x"]) < 0.5)).all()
    assert toxicity.windows(0).tolist() == [0] and toxicity.windows(33).tolist() == [0, 16]


def test_samples_with_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else i, f"t{i}", "a") for i in range(3000)] + [(7000, "same", "a")] * 3000 + [(None, "null", "b")] * 500
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(4)
    got = sampled_rows(df, F.col("lang"), 200, F.col("id"), F.col("text"))
    of = {x: [r for r in got if r["lang"] == x] for x in "ab"}
    assert len(of["a"]) == 200 and len({r["text"] for r in of["a"]}) == 200 and len(of["b"]) == 1
    assert 30 < sum(r["id"] is None for r in of["a"]) < 110
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marks: taken.extend(zip(texts, marks)))
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(300)] + [(2, "two")], "doc_id long, text string")
    toxicity.learn(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), F.lit(True))
    assert taken == [("copy 0", 1), ("two", 0)]


# -- mixing


CELL = "source string, lang string, topic string, tokens long"


def raked_off(raked, targets):
    """The largest relative distance from a target, counted anew."""
    rows, off = raked.toPandas(), 0.0
    for d, target in targets.items():
        got = rows.fillna({d: "?"}).groupby(d)["share"].sum()
        off = max([off, *[abs(got[r[d] or "?"] / r["target"] - 1) for r in target.collect() if r["target"] > 0]])
    return off


def test_raked_shares_meet_the_targets(spark):
    rng = np.random.default_rng(6)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(50, 900))) for i in range(4) for j in range(3) for k in range(2)] + [(None, "l0", "t0", 70)]
    df = spark.createDataFrame(cells, CELL)
    targets = {d: mixing.tempered(df, d, p) for d, p in (("source", 0.3), ("lang", 0.5), ("topic", 0.0))}
    raked, off = mixing.rake(df, targets, tolerance=1e-7)
    assert off <= 1e-7 and raked_off(raked, targets) == pytest.approx(off, abs=1e-12)
    fitted = mixing.calibrate(raked, 0.6).toPandas()
    assert fitted["probability"].between(0, 1).all()
    assert (fitted["probability"] * fitted["tokens"]).sum() == pytest.approx(0.6 * fitted["tokens"].sum(), rel=1e-6)


def test_sparse_shares_are_swept_to_the_tolerance(spark):
    """Most sources have one language and two topics: eight sweeps leave these cells percents away."""
    rng = np.random.default_rng(5)
    cells = [(f"s{i}", f"l{j}", f"t{k}") for i in range(12) for j in {i % 3, (i % 3 + (i % 4 == 0)) % 3} for k in {i % 4, (i + 1) % 4}]
    tokens = [int(10 ** rng.uniform(3, 5)) for _ in cells]
    goal = [t * float(w) for t, w in zip(tokens, 10 ** rng.uniform(-0.4, 0.4, len(cells)))]  # some weights that can be met
    df = spark.createDataFrame([(*c, t) for c, t in zip(cells, tokens)], CELL)
    met = spark.createDataFrame([(*c, g / sum(goal)) for c, g in zip(cells, goal)], "source string, lang string, topic string, g double")
    targets = {d: met.groupBy(d).agg(F.sum("g").alias("target")) for d in ("source", "lang", "topic")}
    raked, off = mixing.rake(df, targets)
    assert off <= mixing.TOLERANCE and raked_off(raked, targets) == pytest.approx(off, abs=1e-12)


def test_targets_that_cannot_be_met_end_the_sweeps(spark):
    df = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 90)], CELL)
    half = {d: df.select(d, F.lit(t).alias("target")).distinct() for d, t in (("source", 0.5), ("topic", 1.0))}
    lang = spark.createDataFrame([("x", 0.9), ("y", 0.1)], "lang string, target double")
    raked, off = mixing.rake(df, {"source": half["source"], "lang": lang, "topic": half["topic"]})
    assert raked.count() == 2 and off == pytest.approx(0.8)
    empty, none = mixing.rake(df.limit(0), half)
    assert empty.count() == 0 and none == 0


def test_every_round_of_the_budget_is_taken(spark):
    """Thirteen rounds make one more cell whole each."""
    level, step, cells = 2.0**30, 2.0**28, []
    for k in range(13):
        cells.append((f"s{k}", "l", "t", int((level - step) * 2.0**-k), 2.0**-k))
        level, step = level + step, step / 2
    df = spark.createDataFrame([*cells, ("last", "l", "t", 2**40, 2.0**-12)], CELL + ", share double")
    budget = 2.0**31 / sum(r["tokens"] for r in df.collect())
    fitted = mixing.calibrate(df, budget).toPandas()
    assert (fitted["probability"] * fitted["tokens"]).sum() == pytest.approx(2.0**31, rel=1e-9)
    assert (fitted["probability"] == 1).sum() == 13


def test_mixing_equals_its_sql(spark, docs):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(queries.oracles()["op3_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.queries()["op3_mixing"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[["doc_id", "topic", "tokens", "kept"]].equals(want[got.columns][["doc_id", "topic", "tokens", "kept"]].astype({"tokens": "int64"}))
    assert np.allclose(got[["probability", "off_target"]], want[["probability", "off_target"]], atol=2e-6)


# -- edge cases and the pipeline


def test_odd_rows_have_defined_results(spark, odd):
    n = odd.count()
    empty = odd.limit(0)
    found = simhash.near_duplicates(odd)
    assert found.count() == n and {"_fingerprint_bits", "_component_id"} <= set(found.columns)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty()
    assert simhash.one_of_each(empty).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.count() == n and mixed.where("_kept IS NULL").isEmpty() and mixing.mix(empty).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(odd, path)
    assert packed.where("start = 0").count() == n and packing.pack(empty, path).count() == 0
    made = fingerprints.fingerprint_edits(odd)
    assert made.count() == n and fingerprints.fingerprint_edits(empty).count() == 0
    told = odd.select("text", language.predict(language.fit([("hello world", "en"), ("hallo welt", "de")]), F.col("text")).alias("p")).collect()
    assert all((r["p"]["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"])) for r in told)
    counted = odd.select(token_counts.truncation(F.col("text"), public_tokenizers.path("word_bpe_49k.json"), 2048).alias("a"))
    assert counted.where("a.n_tokens IS NULL").isEmpty()


def test_pipeline_stages_keep_what_they_should(spark, texts):
    docs = load(spark, SF, "documents")
    extra = spark.createDataFrame([(5000, None, None, None, 0), (5001, "... 123 !!!", "en", "src0", 11), (None, "Is and retitioning of the", None, "src1", 25)], docs.schema)
    told = corpus_pipeline.identify_language(spark, docs.unionByName(extra), SF)
    assert told.columns == docs.columns
    ids = {r["doc_id"]: r["lang"] for r in told.collect()}
    assert set(ids) == {*texts, None} and ids[None] is not None
    clean = corpus_pipeline.drop_near_duplicates(spark, told, SF)
    first = {r["component_id"] for r in simhash.near_duplicates(docs.select("doc_id", "text")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {*first, None}
    mixed = corpus_pipeline.mix_sources(spark, clean, SF)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= clean.count()


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_dedup", "mixing", "packing"]


def test_remainder_is_the_checksum_of_the_text(spark):
    rows = spark.range(50).select("id", remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


# -- memory of the pipeline's Python workers


def test_pieces_are_encoded_once(docs):
    found = docs.select("doc_id", packing.cut(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("pieces"))
    plan = found.select("doc_id", F.inline("pieces"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_small_tables_need_no_workers(spark):
    full, empty = packing.places(spark, [({4: 2}, 3)]), packing.places(spark, [])
    assert "RDD" not in full._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in full.collect()] == [(4, 0, 6, 2, 0, 0)] and empty.collect() == []
    assert full.dtypes == empty.dtypes


def test_stages_bound_the_batches_of_texts(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(key)
    try:
        for before, after in (("10000", "512"), ("0", "512"), ("100", "100")):
            spark.conf.set(key, before)
            corpus_pipeline.drop_near_duplicates(spark, load(spark, SF, "documents"), SF)
            assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, given)

"""Each operator on empty tables, nulls, repeated rows, ties and clashing columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veldspan.llm import decontaminate, lengths, lines, mixing, quality, secretscan, simhash, substrings, surrogates, tokenstore
from veldspan.llm.queries import vocabulary
from veldspan.workspace import Workspace

WORDS = " ".join(f"word{i}" for i in range(60))
#: Names that operators use inside, and the table's own.
SCHEMA = "doc_id long, text string, lang string, source string, key string, row int, w string, fp long, size string, bucket string, g0 string, c0 int, tie int, kept string, n_words string, `odd name` string"
MORE = ("k", 1, "w", 2, "s", "b", "g", 3, 4, "x", "y", "z")
ROWS = [
    (1, WORDS, "en", "a", *MORE), (1, WORDS, "en", "a", *MORE), (1, WORDS + " more", "en", "a", *MORE), (2, None, None, None, *[None] * 12), (None, WORDS, None, "a", *MORE),
    (None, WORDS, None, "a", *MORE), (3, "", "en", None, *MORE), (4, "a " * 50_000, "en", "b", *MORE), (5, "\n\n", "en", "b", *MORE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(WORDS.split()[5:25])), (None, "a a a"), (2, None), (1, "word1 word2")], "item_id long, text string")


def by_key(df, column):
    return sorted((str(r["doc_id"]), r[column]) for r in df.collect())


def test_quality(docs, empty):
    assert quality.quality(empty).isEmpty() and quality.keep(empty).isEmpty()
    got = by_key(quality.quality(docs), "kept")
    assert got == [("1", True)] * 3 + [("2", False), ("3", False), ("4", False), ("5", False)] + [("None", True)] * 2
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["text"] and r["text"].startswith("word0"))


def test_thresholds_against_sorted_values(spark):
    """Fences lie within a sketch's error of the quantiles of sorted values, and small groups take the coarser ones."""
    import random

    rng = random.Random(3)
    values = [("a" if i < 900 else "b", rng.randrange(10_000)) for i in range(930)]
    df = spark.createDataFrame(values, "g string, v long")
    rules = quality.Rule("m", "v", 1, tail=10, reach=3, low=True), quality.Rule("x", "v", 9000, tail=1, reach=1)
    metrics = {"m": F.col("v"), "x": F.col("v")}
    fences = {r.g: r for r in quality.thresholds(quality.sketch(df, ["g"], metrics), ["g"], rules, 100).collect()}

    def at(vs, percent):
        vs = sorted(vs)
        return vs[max(1, (len(vs) * percent + 99) // 100) - 1]

    for g, vs in (("a", [v for x, v in values if x == "a"]), ("b", [v for _, v in values])):
        low, mid, high, top = (at(vs, p) for p in (10, 50, 90, 99))
        assert fences[g].low_m == pytest.approx(low - 3 * (mid - low), rel=0.04) and fences[g].high_m == pytest.approx(high + 3 * (high - mid), rel=0.04)
        assert fences[g].high_x == pytest.approx(top + 9000, rel=0.02) and fences[g].decided_by_floor == "x"  # a tail of 4,900 counts as 9,000


def test_thresholds_follow_their_group(spark):
    """The same text is ordinary in one source and an outlier in another: no fixed cutoff can tell."""
    import random

    rng = random.Random(5)

    def text(size, n=80):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(max(2, round(rng.gauss(size, 0.4))))) for _ in range(n))

    rows = [(k, text(4), "en", "short") for k in range(150)] + [(1000 + k, text(12), "en", "long") for k in range(150)]
    rows += [(5000, text(12), "en", "short"), (5001, text(4), "en", "long"), (5002, text(12), "en", "long"), (5003, text(4), "en", "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not got[5000] and not got[5001] and got[5002] and got[5003]
    assert sum(got[k] for k, *_ in rows[:300]) >= 297


def test_bucket_bounds(spark):
    df = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).select("id", quality.lowest(F.col("b")).alias("lo"), quality.highest(F.col("b")).alias("hi"))
    assert df.where("id < lo OR id > hi OR (hi - lo) * 64 > greatest(id, 1)").isEmpty()


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    path = Workspace(spark, "odd").path
    tokenstore.write(docs, path, vocabulary())
    got = tokenstore.read_back(spark, path).collect()
    lengths_ = sorted((str(k), n) for k, _, n, _ in brute.token_rows([(-1 if r[0] is None else r[0], r[1] or "") for r in ROWS], Tokenizer.from_file(vocabulary())))
    assert sorted((str(-1 if r.doc_id is None else r.doc_id), r.n_tokens) for r in got) == lengths_
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:i]) for i in range(len(order))]
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in got), key=lambda k: (k is not None, k))
    store = tokenstore.TokenStore(spark, path)
    assert len(store.get(1)) == 3 and len(store.get(None)) == 2 and store.get(77) == [] and store.get(3)[0].tolist() == [tokenstore.END_ID]
    none = Workspace(spark, "odd").path
    assert tokenstore.write(empty, none, vocabulary()).isEmpty() and tokenstore.read_back(spark, none).isEmpty()


def test_records_are_read_where_the_hash_leads(spark, monkeypatch):
    path = Workspace(spark, "odd").path
    tokenstore.write(spark.createDataFrame([(k, f"word{k} " * k) for k in range(1, 40)], "doc_id long, text string"), path, vocabulary())
    want = {r.doc_id: r.n_tokens for r in tokenstore.read_back(spark, path).collect()}
    data = f"{path}/data"
    find = tokenstore.ShardIndex.find
    for row in tokenstore.read_manifest(spark, path).collect():
        good = {k: n for b in tokenstore._records(data, row.shard, np.dtype("<u2"), 0) for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)}
        assert good == {k: want[k] for k in good}
        monkeypatch.setattr(tokenstore.ShardIndex, "find", lambda self, keys: tuple(x[::-1] for x in find(self, keys)))
        bad = {k: n for b in tokenstore._records(data, row.shard, np.dtype("<u2"), 0) for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)}
        monkeypatch.setattr(tokenstore.ShardIndex, "find", find)
        assert len(good) < 2 or bad != good


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    index = tokenstore.ShardIndex(tokenstore.build_index(keys, np.arange(len(keys))))
    assert sorted(index.hash.slots(keys)) == list(range(len(keys)))
    first, copies = index.find(keys)
    assert (first == np.arange(len(keys))).all() and (copies == 1).all()
    others = keys[:-1] + 1
    others = others[~np.isin(others, keys)]
    assert (index.find(others)[1] == 0).mean() > 0.999


def test_simhash(docs, empty):
    assert simhash.near_duplicates(empty).isEmpty() and simhash.deduplicate(empty).isEmpty()
    got = by_key(simhash.near_duplicates(docs), "component_id")
    assert [x for x in got if x[0] in ("1", "None")] == [("1", 1)] * 3 + [("None", 1)] * 2 and ("3", 2) in got and ("5", 2) in got
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4"]


def test_simhash_of_many_near_fingerprints(spark):
    """Buckets far over the bound: all links are found against brute force."""
    import random

    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << rng.randrange(20) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for _ in range(400)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    pairs = simhash.links(simhash.buckets(nodes, Workspace(spark, "odd"), most=16)).collect()
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs:
        a, b = r.fp % (1 << 64), r.root % (1 << 64)
        root[find(a)] = find(b)
    want = brute.components([(i, x) for i, x in enumerate(sorted(fps))])
    got = {}
    for i, x in enumerate(sorted(fps)):
        got.setdefault(find(x), []).append(i)
    parts = {}
    for i, c in want.items():
        parts.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(parts.values())


def test_mix(docs, empty):
    assert mixing.mix(empty).isEmpty() and mixing.mixed(empty).isEmpty()
    out = mixing.mix(docs).collect()
    assert len(out) == len(ROWS) and sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)
    assert all(r.size == len(brute.WORD.findall(t or "")) for r, t in ((r, next(x[1] for x in ROWS if x[0] == r.doc_id and len(brute.WORD.findall(x[1] or "")) == r.size)) for r in out))
    assert mixing.mixed(docs).columns == docs.columns


def test_secrets(docs, empty):
    assert secretscan.secrets(empty).isEmpty()
    out = secretscan.secrets(docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("token: abcdefghijkl")).otherwise(F.col("text")))).collect()
    assert sorted((str(r.doc_id), len(r.spans)) for r in out) == sorted((str(k), int(k == 1)) for k in (1, 1, 1, 2, None, None, 3, 4, 5))


def test_token_counts(docs, empty):
    assert lengths.token_counts(empty, vocabulary()).isEmpty()
    hist = lengths.token_counts(docs, vocabulary())
    ns = sorted(n for r in hist.collect() for n in [r.n_tokens] * r.n_docs)
    assert len(ns) == len(ROWS)
    for limit in (0, 1, 7, 100, 10**9):
        r = lengths.truncated(hist, limit).first()
        assert (r.total, r.kept, r.docs_cut) == (sum(ns), sum(min(n, limit) for n in ns), sum(n > limit for n in ns))


def test_substrings(spark, docs, empty):
    assert substrings.SubstringIndex(spark).dedup(empty).isEmpty()
    out = substrings.SubstringIndex(spark).dedup(docs)
    # rows of one key leave each other alone; null keys take no part
    assert [x for x in by_key(out, "n_removed") if x[0] in ("1", "None")] == [("1", 0)] * 3 + [("None", 0)] * 2


def test_substring_batches_are_as_one(spark):
    import random

    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(40)]
    passage = [rng.choice(vocab) for _ in range(30)]
    data = []
    for k in range(60):
        ws = [rng.choice(vocab) for _ in range(rng.randrange(40))]
        cut = rng.randrange(20)
        data.append((k, " ".join(ws[:10] + passage[cut : cut + rng.randrange(8, 25)] + ws[10:])))
    want = brute.substring_rows(data)
    index, got = substrings.SubstringIndex(spark, block_bytes=300), {}
    for a in range(0, 60, 10):
        batch = spark.createDataFrame(data[a : a + 10], "doc_id long, text string")
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in index.dedup(batch).collect()}
    assert got == want
    assert index.runs.groupBy("shard").count().where(F.col("count") > substrings.FANOUT).isEmpty()


def test_surrogates_keep_other_columns_out(docs):
    out = surrogates.pseudonymize(docs, "k")
    assert out.columns[0] == "doc_id" and out.count() == len(ROWS)


def test_lines(spark, docs, empty):
    index = lines.LineIndex(spark, threshold=3)
    assert index.insert(empty).dedup(empty).isEmpty()
    own = index.insert(docs)
    out = own.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    assert sorted((str(r.doc_id), r.n_dropped) for r in out.collect()) == sorted((str(r[0]), int(r[1] == WORDS)) for r in ROWS)


def test_line_index_is_reversible_and_both_ways_agree(spark):
    a = spark.createDataFrame([(i, f"common\nown {i}\nPAIR") for i in range(4)], "doc_id long, text string")
    b = spark.createDataFrame([(i, f"Common \nother {i % 2}\npair") for i in range(10, 14)], "doc_id long, text string")
    one = lines.LineIndex(spark, threshold=5).insert(a)
    both = one.insert(b)
    back = both.delete(b)
    counts = lambda x: sorted((bytes(r.key), r.n) for r in x.counts.collect())
    assert counts(back) == counts(one) and one.frequent().isEmpty() and back.frequent().isEmpty() and both.frequent().count() == 2
    every = a.unionByName(b)
    want = brute.line_rows([tuple(r) for r in every.collect()], threshold=5)
    for size in (1 << 30, 0):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in both.dedup(every, broadcast_bytes=size).collect()}
        assert got == want
    assert all(r.n_dropped == 0 for r in back.dedup(every).collect())


def test_cuckoo_filter():
    import xxhash

    keys = [xxhash.xxh3_128_digest(str(i).encode()) for i in range(3000)]
    f = lines.CuckooFilter(1000)  # far too small: the stash takes what finds no place
    for k in keys[:2000]:
        f.insert(k)
    f = lines.CuckooFilter.load(f.dump())
    assert all(k in f for k in keys[:2000])
    for k in keys[:1000]:
        f.delete(k)
    assert all(k in f for k in keys[1000:2000])


def test_decontaminate(docs, empty, items):
    assert decontaminate.decontaminate(empty, items).isEmpty() and decontaminate.clean(empty, items).isEmpty()
    assert {r.n_hit for r in decontaminate.decontaminate(docs, items.limit(0)).collect()} == {0}
    out = decontaminate.decontaminate(docs, items)
    assert by_key(out, "contaminated") == [("1", True)] * 3 + [("2", False), ("3", False), ("4", True), ("5", False)] + [("None", True)] * 2
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 5]


def test_decontaminate_both_ways_agree(docs, items):
    a = decontaminate.decontaminate(docs, items)
    b = decontaminate.decontaminate(docs, items, max_literals=0)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_mix_buckets_are_small_whatever_the_quality(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat("id", F.lit(f"{i}"))) for i in range(3))).alias("text"), F.lit("a").alias("source"))
    for docs in (rows, rows.withColumn("text", F.regexp_replace("text", "[a-f]", "7")), rows.withColumn("text", F.when(F.col("doc_id") % 2 == 0, "1 2 3").otherwise(F.col("text")))):
        most = mixing._scored(docs, "doc_id", "source", "text", "mix").groupBy("bucket").count().agg(F.max("count")).first()[0]
        assert most <= 40  # 20,000 / (e * 1477) = 5 are expected


def test_mix_takes_nothing_of_a_source_without_words(spark):
    docs = spark.createDataFrame([(1, "", "empty"), (2, None, "empty"), (3, "one two three", "full"), (4, "", "full"), (5, "four", "full")], "doc_id long, text string, source string")
    out = {r.doc_id: (r.epochs, r.selected, r.taken) for r in mixing.mix(docs).collect()}
    assert out[1] == out[2] == (0, False, 0)
    kept = sorted(r.doc_id for r in mixing.mixed(docs).collect())
    assert not {1, 2} & set(kept) and max(kept.count(k) for k in kept) <= 2
    assert {k: kept.count(k) for k in out} == {k: e + s for k, (e, s, _) in out.items()}

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from opinara.llm import chunk_dedup, common, fingerprint, simhash
from tests.llm.conftest import ODD, make


def brute_exact(rows):
    groups, out = defaultdict(list), {}
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for bare, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(bare.encode()).hexdigest())
    return out


def test_exact_dedup_is_brute_force(both):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in chunk_dedup.exact_dedup(both).collect()}
    assert got == brute_exact([(r["doc_id"], r["text"]) for r in both.collect()])


def test_exact_dedup_repeated_rows_and_null_ids(spark, empty):
    docs = make(spark, ["a b", "ab", "ab", "c", "c", None], [1, 1, 1, None, None, None])
    rows = chunk_dedup.exact_dedup(docs).collect()
    assert sorted((r["group_size"], r["kept"]) for r in rows) == [(1, True), (2, False), (2, True), (3, False), (3, False), (3, True)]
    assert {r["keep_id"] for r in rows} == {1, None}
    assert sorted(repr(r["text"]) for r in chunk_dedup.keep_first(docs).collect()) == ["'a b'", "'c'", "None"]
    assert chunk_dedup.exact_dedup(empty).count() == 0
    assert chunk_dedup.keep_first(docs).columns == docs.columns


def test_identifiers_shared_by_other_bytes_are_told_apart(spark, monkeypatch):
    docs = make(spark, ["abc", "abd", "abc"])
    weak = chunk_dedup.recipes(docs).withColumn("recipe", common.F.unhex(common.F.lit("00" * 16)))
    monkeypatch.setattr(chunk_dedup, "recipes", lambda _: weak)
    store = spark.createDataFrame([(b"\0" * 16, b"abc"), (b"\0" * 16, b"abd")], chunk_dedup.CHUNKS)
    monkeypatch.setattr(chunk_dedup, "chunk_store", lambda _: store)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in chunk_dedup.exact_dedup(docs).collect()) == [(0, 0, 2), (1, 1, 1), (2, 0, 2)]


def test_chunks_are_by_content_and_whole():
    rng = random.Random(3)
    body = bytes(rng.randrange(97, 123) for _ in range(60_000))
    a, b = chunk_dedup.chunks_of([body, b"new start" + body])
    assert b"".join(a) == body and b"".join(b) == b"new start" + body
    assert len(set(a) & set(b)) > 0.8 * len(a) > 8
    assert [len(c) for c in next(chunk_dedup.chunks_of([b"x" * 150_000]))][0] <= chunk_dedup.MAX_CHUNK
    assert list(chunk_dedup.chunks_of([b"", b"q"])) == [[], [b"q"]] or list(chunk_dedup.chunks_of([b"", b"q"])) == [[b""], [b"q"]]


def brute_simhash(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, threshold=3):
    ids, fps = list(prints), np.array(list(prints.values()), np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= threshold):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_near_dedup_is_brute_force(both):
    prints = {r["doc_id"]: brute_simhash(r["text"], 3) for r in both.collect()}
    want = {d: (f"{prints[d]:016x}", c) for d, c in brute_components(prints).items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_dedup(both, 3).collect()}
    assert got == want


def test_near_dedup_odd_inputs(spark, empty):
    assert simhash.near_dedup(empty).count() == 0
    rows = simhash.near_dedup(make(spark, [None, "", "a b"], [None, None, 4]), 3).collect()
    assert sorted((r["fingerprint"] == "0" * 16, r["component_id"]) for r in rows if r["doc_id"] is None) == [(True, None)] * 2


def test_every_link_meets_at_an_anchor(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64) << np.uint64(1)
    fps = [base]
    for n in (1, 2, 3, 4):
        flips = np.zeros(len(base), np.uint64)
        for _ in range(n):
            flips |= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
        fps.append(fps[-1] ^ flips)
    values = np.unique(np.concatenate(fps))
    want = brute_components(dict(enumerate(values.tolist())))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in common.components(simhash.near_links(df)).collect()}
    groups = defaultdict(set)
    for i, v in enumerate(values.view(np.int64).tolist()):
        groups[want[i]].add(got.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({g.pop() for g in groups.values()}) == len(set(want.values()))


def test_crowded_anchor_is_split_exactly(spark):
    rng = np.random.default_rng(6)
    other = rng.integers(0, 1 << 31, 6000)
    other[3000:] = other[:3000] ^ (1 << rng.integers(0, 31, 3000))
    fps = np.unique(other << 32)
    assert len(fps) > simhash.CROWD
    df = spark.createDataFrame([(int(v),) for v in fps], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.near_links(df)).collect()}
    prints = dict(enumerate(fps.tolist()))
    want, groups = brute_components(prints), defaultdict(set)
    for i, v in prints.items():
        groups[want[i]].add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({g.pop() for g in groups.values()}) == len(set(want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def brute_canonical(text):
    import unicodedata

    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def test_fingerprints_follow_canonical_forms(both):
    rows = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(both).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    order = sorted(texts, reverse=True)
    forms = defaultdict(set)
    for d, after in zip(order, order[1:] + order[:1]):
        n, k = len(texts[d]), len(texts[d]) // 3
        edited = texts[d][: n - k] + texts[after][:k]
        r = rows.pop(d)
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        forms[brute_canonical(texts[d])].add(r["fingerprint"])
        forms[brute_canonical(edited)].add(r["edited_fingerprint"])
        assert r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"])
        assert r["near_next"] == float(brute_canonical(texts[d]) == brute_canonical(texts[after]))
    assert not rows and all(len(v) == 1 for v in forms.values())
    assert len({v for s in forms.values() for v in s}) == len(forms)


def test_fingerprints_odd_inputs(spark, empty):
    assert fingerprint.edited_fingerprints(empty).count() == 0
    (one,) = fingerprint.edited_fingerprints(make(spark, ["abcdef"])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    rows = fingerprint.edited_fingerprints(make(spark, ["abc", "abc", None, None], [1, 1, None, 7])).collect()
    assert len(rows) == 4


def test_a_shared_hash_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda canon: fingerprint.F.lit("0" * 32))
    rows = fingerprint.fingerprints(make(spark, ["a", "A", "b"])).collect()
    assert len({r["fingerprint"] for r in rows}) == 2
    rows = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(make(spark, ["aaa", "AAA", "bbb"])).collect()}
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] != rows[2]["fingerprint"]
    assert all(r["near_edited"] == 0 or r["doc_id"] == 1 for r in rows.values())


@pytest.mark.parametrize("text", ODD)
def test_simhash_of_odd_texts(text):
    assert simhash.fingerprint((text or "").encode(), 3) == brute_simhash(text, 3)


def test_similar_documents_are_grouped(spark, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(200)]
        copy = list(words)
        for at in rng.sample(range(200), 3):
            copy[at] = word()
        texts += [" ".join(words), " ".join(copy)]
    texts += ["", None, "short one", "short one"]
    docs = make(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    together = sum(got[i] == got[i + 1] for i in range(0, 80, 2))
    assert together >= 36 and all(got[i] in (i, i - 1) for i in range(80))
    assert got[80] == got[81] == 80 and got[82] == got[83] == 82
    kept = simhash.keep_one(docs)
    assert kept.count() == len(set(got.values())) and kept.columns == docs.columns
    assert simhash.keep_one(empty).count() == 0


def brute_similar(texts, width=5, similarity=0.8):
    words = {d: (t or "").lower().split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for d, w in words.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_similar_groups_begin_with_simhash(spark, monkeypatch):
    """Links of fingerprints unite texts without any help of prefixes, but none whose sets are too unlike."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(300)]
        texts += [" ".join(words), " ".join(words[:-3] + [word() for _ in range(3)])]
    once, unlike = "a b c d e f g h i j", " ".join("q" * 60)
    texts += [once, " ".join([once] * 2), unlike, unlike + " w x y z"]
    docs, prints = make(spark, texts), [simhash.fingerprint(t.encode(), 5) for t in texts]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3
    linked = [i for i in range(0, 120, 2) if near(i, i + 1)]
    assert len(linked) > 20 and near(122, 123) and brute_similar(dict(enumerate(texts)))[123] == 123
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()} == brute_similar(dict(enumerate(texts)))
    monkeypatch.setattr(simhash, "_first_pairs", lambda batches, similarity: iter(()))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert {i for i in range(0, 120, 2) if got[i + 1] == i} == set(linked) and got[123] == 123


def test_similar_groups_are_brute_force(spark, documents):
    """Copies on either side of the threshold: none below it is taken for one, and none above it is missed."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [r["text"] for r in documents.where("length(text) < 5000").collect()]
    for edits in range(1, 16):
        words = [word() for _ in range(250)]
        copy = list(words)
        for at in rng.sample(range(250), edits):
            copy[at] = word()
        texts += [" ".join(words), " ".join(copy)]
    docs = make(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == brute_similar(dict(enumerate(texts)))


def test_lightest_forest_is_brute_force():
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 40, (2, 300))
    a, b, weight = a[a != b], b[a != b], rng.integers(0, 9, (a != b).sum())
    root, want = list(range(40)), []
    for at in np.lexsort((b, a, weight)):
        x, y = root[a[at]], root[b[at]]
        if x != y:
            root = [min(x, y) if r in (x, y) else r for r in root]
            want.append(at)
    found = simhash.lightest(a, b, weight)
    assert sorted(found.tolist()) == sorted(want)
    two = simhash.forests(a, b, weight)
    assert set(found.tolist()) < set(two.tolist()) and len(set(two.tolist())) == len(two)
    none = np.zeros(0, np.int64)
    assert len(simhash.forests(none, none, none)) == 0


def test_rows_that_share_a_doc_id_but_not_a_text(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(reversed(words)), " ".join([*words[:99], "other"]), None]
    kept = simhash.keep_one(make(spark, texts, [1, 1, 2, None])).collect()
    assert sorted(r["text"] or "" for r in kept) == sorted(["", texts[0], texts[1]])  # a row for each group, whatever its doc_id


def blocks(rng, words):
    """A text of words and copies of it that differ in one stretch, of Jaccard similarity between 0.8 and 0.84."""
    n = len(words)
    word = lambda: "w%06d" % rng.randrange(10**6)
    k, r = int(0.2 * n) - 1, (n - 4) // 9 - 4
    at = rng.randrange(n - r)
    return [words + [word() for _ in range(k)], words[: n - k], words[:at] + [word() for _ in range(r)] + words[at + r :], words]


def test_copies_that_differ_in_one_stretch_are_grouped(spark):
    rng, texts = random.Random(11), []
    for n in (60, 200, 1000):
        for _ in range(25):
            base = ["w%06d" % rng.randrange(10**6) for _ in range(n)]
            texts += [*map(" ".join, blocks(rng, base))]
    want = brute_similar(dict(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(make(spark, texts)).collect()}
    together = sum(got[i] == got[i | 3] for i in range(len(texts)) if i % 4 < 3)
    assert got == want and together == len(texts) // 4 * 3, f"{together} of {len(texts) // 4 * 3} copies are with their text"


def crowd(rng, n):
    """Texts of one template, most of similarity 0.6 to 0.8, some over it."""
    base = ["w%06d" % rng.randrange(10**6) for _ in range(200)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(2, 10)):
            copy[at] = "w%06d" % rng.randrange(10**6)
        texts.append(" ".join(copy))
    return texts


def test_no_link_of_a_crowd_is_lost(spark):
    texts = crowd(random.Random(12), 400)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(make(spark, texts)).collect()}
    want = brute_similar(dict(enumerate(texts)))
    assert got == want, f"{len(set(got.values()))} groups, not {len(set(want.values()))}"


def test_sketches_never_rule_out_what_is_alike():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = (int(rng.integers(0, 400)) for _ in range(2))
        pool = rng.integers(0, 1 << 63, 800).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, k)) if k else pool[:0] for k in (n, m))
        differ = len(np.setxor1d(a, b))
        assert simhash._unlike(simhash._sketch(a), simhash._sketch(b)) <= differ


def test_texts_move_to_few_of_a_crowds_pairs(spark, monkeypatch):
    """Of texts that are alike but under 0.8, of which nearly all pairs pass the bounds of their prefixes, hardly any move."""
    rng = random.Random(1)
    base, places = [f"w{i}" for i in range(300)], rng.sample(range(300), 14)
    texts = [" ".join(f"v{rng.randint(0, 7)}" if i in places else w for i, w in enumerate(base)) for _ in range(120)]
    met, checked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(f, counter):
        def counted(batches, **given):
            def each():
                for batch in batches:
                    counter.add(batch.num_rows)
                    yield batch

            return f(each(), **given)

        return counted

    monkeypatch.setattr(simhash, "_could", counting(simhash._could, met))
    monkeypatch.setattr(simhash, "_verified", counting(simhash._verified, checked))
    simhash.similar_groups(make(spark, texts)).collect()
    assert met.value > 20 * len(texts) and checked.value < 4 * len(texts)


def test_other_texts_of_a_doc_id_stay(spark):
    words = [f"w{i}" for i in range(100)]
    long, unique = " ".join(words), "only here"
    docs = make(spark, [long, long, unique], [1, 2, 2])
    assert sorted(r["text"] for r in chunk_dedup.keep_first(docs).collect()) == sorted([long, unique])
    near = make(spark, [long, long + " more", unique, unique, "x", None, None], [1, 2, 2, 2, None, None, None])
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in simhash.keep_one_row(near).collect())
    assert got == [(-1, ""), (-1, "x"), (1, long), (2, unique)]


def test_no_link_of_a_crowded_shingle_is_lost(spark):
    """More near copies than a task compares with each other, some of them linked only by others."""
    rng, base = random.Random(13), [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(simhash.CROWD + 900):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
            copy[at] = f"x{rng.randrange(3)}"
        texts.append(" ".join(copy))
    place = {}
    sets = [{place.setdefault(tuple(w[i : i + 5]), len(place)) for i in range(116)} for w in map(str.split, texts)]
    x = np.zeros((len(texts), len(place)), np.float32)
    for row, s in enumerate(sets):
        x[row, list(s)] = 1
    both, n = x @ x.T, x.sum(axis=1)
    linked = both >= 0.8 * (n[:, None] + n[None] - both) - 1e-3
    want = np.full(len(texts), -1)
    for start in range(len(texts)):
        front = np.array([start]) if want[start] < 0 else np.zeros(0, int)
        want[front] = start
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (want < 0))
            want[front] = start
    docs = spark.range(0, len(texts), numPartitions=4).selectExpr("id as doc_id").join(make(spark, texts).select("doc_id", "text"), "doc_id")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert len(set(want)) > 10 and got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("words", [8, 16, 24, 40, 250])
def test_pairs_over_the_threshold_are_found_at_every_length(spark, words):
    rng, texts = random.Random(words), []
    for _ in range(100):
        base = ["w%05d" % rng.randrange(10**5) for _ in range(words)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join(base[:-1] + ["other"])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(make(spark, texts)).collect()}
    assert got == brute_similar(dict(enumerate(texts)))


def test_columns_of_any_name_and_other_texts_of_an_id_stay(spark):
    schema = "doc_id long, text string, _key string, _nth int, key string, row string, tie map<string,int>, nth int, bare string"
    rows = [(1, "unique short"), (1, "a much longer text shared by two"), (2, "a much longer text  shared by two "), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "k", i, "x", "y", {"a": i}, i, "b") for i, r in enumerate(rows)], schema)
    for keep in (chunk_dedup.keep_first, simhash.keep_one):
        kept = keep(docs)
        assert kept.schema == docs.schema
        got = [(r["doc_id"], r["text"], r["_key"], r["key"], r["bare"]) for r in kept.collect()]
        assert len(got) == 3 and {g[1] for g in got} >= {"unique short"} and {g[2:] for g in got} == {("k", "x", "b")}
    assert [r["doc_id"] for r in chunk_dedup.keep_first(docs).where("text like 'a much%'").collect()] == [2]
    assert chunk_dedup.keep_first(docs.where("doc_id < 0")).schema == docs.schema == simhash.keep_one(docs.where("doc_id < 0")).schema


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_components_are_made_by_small_plans(spark, monkeypatch):
    """Chains, a star and a ring, in rounds of which no plan reads its table more than a few times; the result is a table."""
    plans, durable = [], common.durable
    monkeypatch.setattr(common, "durable", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or durable(df, name))
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300)]
    found = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)] + [(i, 200) for i in range(200, 203)]
    assert max(p.count("FileScan") for p in plans) <= 2 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
